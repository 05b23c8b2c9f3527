"""Frames for the tests of the text operators; a conftest of this folder would hide the one above."""

import os
import random
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)
# Workers import the package as well, wherever pytest was started.
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tid string, row int, `odd name` int"


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))


def document(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), "x", 1, 2)


@pytest.fixture(scope="session")
def mixed():
    """Nulls, empty and blank texts, repeated rows, one id with two texts, copies, near copies, shared passages, a long text."""
    base, passage = prose(120, 1), prose(60, 2)
    near = base.split()
    near[50] = "changed"
    rows = [
        document(5, base), document(9, base), document(9, base), document(12, " ".join(near)), document(None, base), document(None, None),
        document(3, None), document(4, ""), document(6, " \n\t "), document(7, "one two"), document(8, "one  two"), document(7, prose(30, 3)),
        document(20, prose(25, 4) + " " + passage + " " + prose(25, 5)), document(21, prose(31, 6) + " " + passage),
        document(22, passage + "\n" + passage), document(30, prose(6000, 7), None), document(31, "12345 !!! ..."),
    ]
    return rows + [document(100 + i, base + " " + prose(3, 100 + i)) for i in range(12)]


@pytest.fixture(scope="session")
def docs(spark, mixed):
    return spark.createDataFrame(mixed, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """(doc_id, text) of the smallest given documents, and their folder."""
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return SF, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
