"""Standing registry tables and FASTA splits."""

import random
import shutil

from pyspark.sql import functions as F

from varloom import session
from varloom.operators import intervals, standing
from varloom.sources import files
from varloom.streaming.register_stream import event_batch, register_stream

BATCH = "row_id long, variant_key string, ref_id long, n_left long, n_right long, category int, length_change long, inserted string, original string, given_id long"
IDS = "row_id long, id_type string, id long, attrs string"


def rows(*items):
    return [(i, f"{ref}:{left}", ref, left, left + 1, 0, 0, "A", "C", given) for i, ref, left, given in items]


def state(spark, path):
    return tuple(sorted(map(tuple, standing.read(spark, path, t).collect())) for t in ("variants", "identifiers", "holders", "tops"))


def test_batches_add_and_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path / "registry")
    make = lambda *x: spark.createDataFrame(rows(*x), BATCH)
    ids = lambda *x: spark.createDataFrame(list(x), IDS)
    far = 3 * standing.SPAN
    answers = lambda df: {r.row_id: (r.ca_id, r.error) for r in df.collect()}
    assert answers(standing.register(path, make((1, 1, 20, None), (2, 1, 10, None), (3, 1, 20, None), (4, 2, far, 7)), ids((1, "dbSNP", 5, "x"), (3, "dbSNP", 5, "y"), (4, "dbSNP", 9, None)), 1)) == {
        1: (9, None), 2: (8, None), 3: (9, None), 4: (7, None)}
    first = state(spark, path)
    second = make((1, 1, 20, None), (2, 5, 1, 8), (3, 6, 1, None), (4, 1, 10, 99), (5, 2, far, None)), ids((1, "dbSNP", 5, "z"), (1, "dbSNP", 6, None), (3, "dbSNP", 6, None), (4, "dbSNP", 77, None))
    want = {1: (9, None), 2: (None, "IdentifierTaken"), 3: (10, None), 4: (None, "IdentifierMismatch"), 5: (7, None)}
    assert answers(standing.register(path, *second, 2)) == want
    after = state(spark, path)
    assert answers(standing.register(path, *second, 2)) == want and state(spark, path) == after  # a replay
    # A job lost between two tables runs again.
    shutil.rmtree(f"{path}/identifiers/part=6-0")
    assert answers(standing.register(path, *second, 2)) == want and state(spark, path) == after
    assert all(set(a) <= set(b) for a, b in zip(first, after))
    assert sorted((r.variant_key, r.id, r.attrs) for r in standing.read(spark, path, "identifiers").collect()) == [("1:20", 5, "x"), ("1:20", 6, None), (f"2:{far}", 9, None), ("6:1", 6, None)]
    assert answers(standing.register(path, make(), ids(), 3)) == {} and state(spark, path)[:3] == after[:3]
    assert answers(standing.register(path, make((1, 9, 1, None)), ids(), 4)) == {1: (11, None)}


def test_a_batch_reads_its_key_ranges_only(spark, tmp_path):
    path = str(tmp_path / "registry")
    none = spark.createDataFrame([], IDS)
    for n in range(1, 5):
        standing.register(path, spark.createDataFrame(rows(*((i, n, i, None) for i in range(20))), BATCH), none, n)
    old = standing.read(spark, path, "variants", 5).where(F.col("part").isin(["2-0"]))
    assert old.count() == 20 and "part#" in old._jdf.queryExecution().toString().split("PartitionFilters")[1]
    assert {r.batch for r in old.collect()} == {2} and standing.read(spark, path, "variants").agg(F.max("ca_id"), F.countDistinct("ca_id")).first()[:] == (80, 80)


def test_stream_of_several_batches(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 7 if i % 11 else None) for i in range(60)], "event_id long, user_id long")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        register_stream(stream, str(tmp_path / "reg"), event_batch, str(tmp_path / "check")).awaitTermination()
    variants, known = (standing.read(spark, str(tmp_path / "reg"), t) for t in ("variants", "identifiers"))
    assert variants.select("batch").distinct().count() >= 1 and known.select("batch").distinct().count() == 5
    assert sorted(r.n_left for r in variants.collect()) == list(range(7)) and sorted(r.ca_id for r in variants.collect()) == list(range(1, 8))
    assert known.count() == events.where("user_id is not null").count()


def test_fasta_chunks_from_splits(spark, tmp_path):
    rng = random.Random(7)
    texts, lines = {}, ["letters before any header", ""]
    for i, n in enumerate([0, 1, 59, 4095, 4096, 4097, 9000, 30000, 64]):
        seq = "".join(rng.choice("acgtN") for _ in range(n))
        texts[f"r{i}"] = seq.upper()
        lines.append(f"> r{i} words" if i % 2 else f">r{i}")
        at = 0
        while at < n:
            step = rng.choice([1, 60, 61, 500])
            lines += [seq[at:at + step] + rng.choice(["", "\r", " "])] + rng.choice([[], [], [""], ["# comment >x"]])
            at += step
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "b.fasta").write_text(">other\nACGT\n")
    want = {(r.ref_id, r.chunk_no, r.ctx_left, r.ctx, r.ref_len) for r in intervals.ref_chunks(
        spark.createDataFrame([*texts.items(), ("other", "ACGT")], "ref_id string, seq string")).collect()}
    for size in ("700", "5000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = [tuple(r) for r in files.fasta_chunks(spark, str(tmp_path / "in")).collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(got) == len(want) and set(got) == want, size


def test_stored_tables_follow_their_files(spark, tmp_path):
    path = str(tmp_path / "data")
    made = lambda: session.stored(spark, "test", path, lambda: spark.read.parquet(path)).count()
    spark.range(5).write.parquet(path)
    assert made() == 5
    spark.range(8).write.mode("append").parquet(path)
    assert made() == 13
