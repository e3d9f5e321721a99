"""A store whose paths nothing but itself opens, and one whose first attempt at a shard fails."""

from pathlib import Path

from quern.sources.stores import LocalStore


class OnlyStore(LocalStore):
    def __init__(self, folder):
        assert folder.startswith("only://")

    @staticmethod
    def _plain(path):
        return Path("/" + path.removeprefix("only://"))


class FailsOnce(OnlyStore):
    def create(self, path):
        out = super().create(path)
        flag = Path(str(self._plain(path)).split("/_temporary/")[0] + ".failed")
        if path.endswith("train_00001.bin") and not flag.exists():
            flag.touch()
            out.write(b"half")
            out.close()
            raise OSError("the disk is gone")
        return out


class FailsAlways(OnlyStore):
    def create(self, path):
        if path.endswith("train_00001.bin"):
            super().create(path).close()
            raise OSError("the disk is gone")
        return super().create(path)
