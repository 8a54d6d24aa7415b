import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from limpid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture()
def frame(spark):
    """Build a frame from columns; ``None`` is a gap. Types: int, float, bool or str, by content."""
    def build(row_id=True, **columns):
        names = list(columns)
        rows = [tuple(r) for r in zip(*columns.values())]
        kinds = []
        for values in columns.values():
            seen = {type(v) for v in values if v is not None}
            kind = ("boolean" if seen == {bool} else "bigint" if seen == {int}
                    else "double" if seen and seen <= {int, float} else "string")
            kinds.append(kind)
        casts = {"bigint": int, "double": float, "boolean": bool, "string": str}
        rows = [tuple(None if v is None else casts[k](v) for v, k in zip(r, kinds)) for r in rows]
        if row_id:
            rows = [(i, *r) for i, r in enumerate(rows)]
        schema = (["__row_id bigint"] if row_id else []) + ["`" + n.replace("`", "``") + f"` {k}" for n, k in zip(names, kinds)]
        return spark.createDataFrame(rows, ", ".join(schema))
    return build
