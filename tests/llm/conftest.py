import zlib

import pytest

LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(70))


def hard_rows():
    """(doc_id, text): nulls, blanks, a very long text, copies, near copies and repeated rows."""
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(120))
    return [
        (None, base), (None, None), (1, base), (2, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \n\t "),
        (7, LONG), (8, LONG + " more"), (9, "x"), (9, "y z"), (10, "A b"), (11, "a B"), (12, "lead " + PASSAGE + " end one"),
        (13, "other start " + PASSAGE + " and another end"), (14, PASSAGE.upper()), (15, "12 34 !!"), (16, "é à ü ß 日本"),
    ]


@pytest.fixture(scope="session")
def hard(spark):
    """The rows with further columns whose names occur inside the operators."""
    rows = [(i, t, None if k % 3 else "en", f"s{k % 2}", k, k, None, "c", -1) for k, (i, t) in enumerate(hard_rows())]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "digest bigint, first int, component string, item_id bigint")


@pytest.fixture(scope="session")
def empty(hard):
    return hard.where("false")


def in_fold(doc_id, folds, fold=0):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold
