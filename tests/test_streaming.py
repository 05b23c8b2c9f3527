"""The stream against one batch run over all files, in any order, with failures in between."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelscore.operators import clean
from panelscore.sources import versions
from panelscore.streaming import upsert

SCHEMA = "entity string, indicator string, period string, value string, source string, seq long"
KEYS = ("entity", "indicator", "period", "value", "source", "seq")


def observations(seed, n=300):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        period = "n/a" if k % 29 == 0 else str(2000 + rng.randrange(8))
        value = rng.choice([None, "x", str(rng.randrange(50))]) if k % 7 == 0 else str(rng.randrange(50))
        out.append((f" e{rng.randrange(6)} ", rng.choice("AB"), period, value, rng.choice(["s", None]), k if k % 11 else None))
    rng.shuffle(out)
    return out


def wanted(spark, out):
    return rows(clean.keep_last(clean.drop_incomplete(clean.normalize(spark.createDataFrame(out, SCHEMA)))), *KEYS)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_ends_in_the_batch_result(spark, tmp_path, seed):
    out, folder = observations(seed), str(tmp_path)
    for k in range(4):
        part = out[k::4] + out[:20]
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(f"{folder}/landed")
        table = upsert.run(spark, f"{folder}/landed", f"{folder}/t", f"{folder}/c", SCHEMA, options={"maxFilesPerTrigger": "1"})
    assert rows(table, *KEYS) == wanted(spark, out)
    facts = versions.current(spark, f"{folder}/t").facts
    assert facts[f"batch of {folder}/c"] == 7 and facts["high"] == 2007 and facts["late"] > 0
    assert facts["rows"] == sum(1 for k in range(4) for r in out[k::4] + out[:20] if r[2] != "n/a")
    # Nothing new: no new version.
    before = versions.current(spark, f"{folder}/t").number
    upsert.run(spark, f"{folder}/landed", f"{folder}/t", f"{folder}/c", SCHEMA)
    assert versions.current(spark, f"{folder}/t").number == before


def test_a_batch_that_failed_or_is_repeated(spark, tmp_path, monkeypatch):
    out, folder = observations(3), str(tmp_path)
    spark.createDataFrame(out[:150], SCHEMA).coalesce(1).write.parquet(f"{folder}/landed")
    commit = versions.commit

    def failing(*args, **options):
        commit(*args, **options)
        raise RuntimeError("lost after the commit")

    monkeypatch.setattr(versions, "commit", failing)
    with pytest.raises(Exception, match="lost after the commit"):
        upsert.run(spark, f"{folder}/landed", f"{folder}/t", f"{folder}/c", SCHEMA)
    monkeypatch.setattr(versions, "commit", commit)
    assert versions.current(spark, f"{folder}/t").number == 1
    # The stream runs the batch again; the table has it already and counts it once.
    table = upsert.run(spark, f"{folder}/landed", f"{folder}/t", f"{folder}/c", SCHEMA)
    assert rows(table, *KEYS) == wanted(spark, out[:150]) and versions.current(spark, f"{folder}/t").number == 1
    spark.createDataFrame(out[150:], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
    table = upsert.run(spark, f"{folder}/landed", f"{folder}/t", f"{folder}/c", SCHEMA)
    assert rows(table, *KEYS) == wanted(spark, out)


def test_late_rows_set_aside(spark, tmp_path):
    folder = str(tmp_path)
    early = [("E", "A", str(p), "1", "s", p - 2000) for p in (2005, 2006)]
    later = [("E", "A", "2003", "9", "s", 90), ("E", "A", "2005", "9", "s", 91), ("E", "A", "2004", "9", "s", 92)]
    spark.createDataFrame(early, SCHEMA).write.parquet(f"{folder}/landed")
    upsert.run(spark, f"{folder}/landed", f"{folder}/t", f"{folder}/c", SCHEMA, lateness=2, aside=f"{folder}/late")
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
    table = upsert.run(spark, f"{folder}/landed", f"{folder}/t", f"{folder}/c", SCHEMA, lateness=2, aside=f"{folder}/late")
    assert rows(table, "period", "value") == [(2004, 9.0), (2005, 9.0), (2006, 1.0)]
    assert rows(spark.read.parquet(f"{folder}/late"), "period", "seq") == [(2003, 90)]
    assert versions.current(spark, f"{folder}/t").facts["late"] == 1


def test_csv_files_and_nothing_landed(spark, tmp_path):
    folder = str(tmp_path)
    (tmp_path / "landed").mkdir()
    assert upsert.run(spark, f"{folder}/landed", f"{folder}/t", f"{folder}/c", SCHEMA, fmt="csv") is None
    (tmp_path / "landed" / "a.csv").write_text("e1,A,2001,5,s,1\nbroken line\n,A,2001,5,s,2\n e1,A,2001,6,s,3\n")
    table = upsert.run(spark, f"{folder}/landed", f"{folder}/t", f"{folder}/c", SCHEMA, fmt="csv")
    assert rows(table, "entity", "value", "seq") == [("E1", 6.0, 3)]
