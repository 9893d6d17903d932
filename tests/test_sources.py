"""CSV files with BOM, quotes, bad rows and undated names; replayed streaming batches."""

from pyspark.sql import functions as F

from hirelake.plans import catalog as C
from hirelake.sources import csv as CSV
from hirelake.streaming import jobs as ST

SMALL = "/root/testdata/sf0.001"


def test_csv_bom_quotes_bad_rows_and_undated_files(spark, tmp_path):
    head = ",".join(CSV.CSV_HEADER)
    good = "회사,\"제목, 쉼표\",경력,대졸,정규직,서울,3000만원,~01/02,\"여러\n줄\",http://x/1"
    (tmp_path / "posts_2026-01-01.csv").write_bytes(b"\xef\xbb\xbf" + f"{head}\n{good}\nonly,three,cells\n{good}\n".encode())
    (tmp_path / "posts.csv").write_text(f"{head}\n{good}\n")
    rows, bad = CSV.read_csv_postings(spark, str(tmp_path))
    got = rows.orderBy("posting_id").collect()
    assert [r.posting_id for r in got] == [1, 2] and {r.company for r in got} == {"회사"}
    assert got[0].title == "제목, 쉼표" and got[0].description_raw == "여러\n줄" and str(got[0].batch_date) == "2026-01-01"
    assert bad.count() == 2
    assert CSV.read_csv_postings(spark, str(tmp_path), as_of="2026-02-03")[0].count() == 3


def test_csv_ids_over_many_files(spark, tmp_path):
    n = 200_000
    (spark.range(n).select(*[F.concat(F.lit(h[:1]), F.col("id")).alias(h) for h in CSV.CSV_HEADER]).repartition(9)
     .write.option("header", True).csv(str(tmp_path / "p_2026-01-01")))
    rows, _ = CSV.read_csv_postings(spark, str(tmp_path / "*"))
    r = rows.agg(F.count("*"), F.count_distinct("posting_id"), F.max("posting_id"), F.count_distinct("title")).first()
    assert tuple(r) == (n, n, n, n)


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    raw = C._tables(spark, SMALL)["postings_raw"].withColumn("title", F.when(F.col("posting_id") % 5 > 0, F.col("title")))
    raw.write.parquet(str(tmp_path / "raw"))
    sink = str(tmp_path / "fact")
    ST.stream_ingest(spark, str(tmp_path / "raw"), raw.schema, sink, str(tmp_path / "c1"))
    first = spark.read.parquet(sink).drop("batch_id").collect()
    # a lost checkpoint: the same files come again as batch 0
    ST.stream_ingest(spark, str(tmp_path / "raw"), raw.schema, sink, str(tmp_path / "c2"))
    assert sorted(map(str, spark.read.parquet(sink).drop("batch_id").collect())) == sorted(map(str, first))
    assert any(r.announcement_name is None for r in first)


def test_late_events_are_dropped_after_the_watermark(spark, tmp_path):
    ev = lambda d: spark.createDataFrame([(d, "a")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    path, sink = str(tmp_path / "e"), str(tmp_path / "s")
    for day in ("2026-01-01 01:00:00", "2026-01-20 01:00:00", "2026-01-19 03:00:00", "2026-01-02 01:00:00"):
        ev(day).write.mode("append").parquet(path)
        ST.stream_daily_counts(spark, path, ev(day).schema, sink, str(tmp_path / "c"))
    days = {str(r.window_start)[:10] for r in ST.current_daily_counts(spark, sink).collect()}
    assert days == {"2026-01-01", "2026-01-20", "2026-01-19"}


def test_no_scratch_folder_off_a_local_master(spark, monkeypatch):
    import pytest

    from hirelake import session as S

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return type("Conf", (), {"get": lambda self, k, d=None: d})()

        def getCheckpointDir(self):
            return None

    with pytest.raises(RuntimeError):
        S.checkpoint_dir(type("Session", (), {"sparkContext": Context()})())
