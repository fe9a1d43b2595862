import gzip

from pyspark.sql import functions as F

from linkloom.plans.config import parse_config
from linkloom.sources import readers, writers
from linkloom.streaming import reads as stream


def test_fastq(spark, tmp_path):
    text = "@r1#1_2_3/1\t7\t1\nACGT\n+\n@III\n@r2#0_0_0/1\nAC\n+\nII\n@r3#4_5_6/1\nA\n+\n@"
    with gzip.open(tmp_path / "r.fq.gz", "wt") as f:
        f.write(text)
    rows = readers.read_fastq(spark, str(tmp_path / "r.fq.gz")).orderBy("read_no").collect()
    assert [(r["read_no"], r["read_name"], r["barcode_str"], r["barcode_num"]) for r in rows] == [(1, "r1", "1_2_3", 7), (2, "r2", "0_0_0", None), (3, "r3", "4_5_6", None)]


def test_fasta_and_import(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 desc\nACGT\n\n>empty\n>s2\nGG\nTT")
    rows = readers.read_fasta(spark, str(tmp_path / "a.fa")).withColumn("at", F.monotonically_increasing_id())
    got = readers.import_contigs(rows).orderBy("contig").collect()
    assert [(r["contig"], r["length"], r["name"], r["cov"], r["seq"]) for r in got] == [(1, 4, "s1", 18.0, "ACGT"), (3, 4, "s2", 18.0, "GGTT")]


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:1\tLN:9\n@PG\tID:x\nr#1_2_3\t99\t1\t101\t60\t5S95M\t=\t301\t300\t*\t*\tNM:i:0\tXA:Z:y\n")
    row = readers.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert (row["flag"], row["pos"], row["cigar"], row["tlen"], row["tags"]) == (99, 101, "5S95M", 300, ["NM:i:0", "XA:Z:y"])
    assert {(r["kind"], tuple(sorted(r["fields"].items()))) for r in readers.read_sam_header(spark, str(tmp_path / "a.sam")).collect()} == {("SQ", (("LN", "9"), ("SN", "1"))), ("PG", (("ID", "x"),))}


def test_text_round_trips(spark, tmp_path):
    save = lambda df, order: (writers.save(df, str(tmp_path / "x"), order), str(tmp_path / "x"))[1]
    positions = spark.createDataFrame([(1, 96, 7), (1, 96, 9), (1, 120, 7), (3, 5, 9)], "contig long, pos int, barcode long")
    path = save(writers.position_lines(positions), ["contig"])
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ["1\t96:7|9\t120:7", "3\t5:9"]
    assert sorted(map(tuple, readers.read_barcode_positions(spark, path).collect())) == sorted(map(tuple, positions.collect()))
    chains = spark.createDataFrame([(1, 0, 5), (1, 1, 1), (2, 0, 3)], "chain_id long, idx int, contig long")
    assert sorted(map(tuple, readers.read_chains(spark, save(writers.chain_lines(chains), ["chain_id", "idx"])).collect())) == sorted(map(tuple, chains.collect()))
    links = spark.createDataFrame([(317165, 346282, 11, -153)], "src long, dst long, cnt long, len int")
    path = save(writers.dot_lines(links, directed=True), ["k"])
    assert [tuple(r) for r in readers.read_links(spark, path, 200, 3).collect()] == [(317165, 346282, 11, -153)]
    assert readers.read_links(spark, path, 100, 3).count() == 0


def test_fasta_lines_and_agp_header(spark):
    row = writers.fasta_lines(spark.createDataFrame([("s", "A" * 205)], "name string, seq string")).first()["value"]
    assert [len(x) for x in row.split("\n")] == [2, 100, 100, 5]
    rows = spark.createDataFrame([("test1", 1, 1000, 1, "W", "contig1", "1", "1000", "+")], "object string, object_beg long, object_end long, part_number int, component_type string, c6 string, c7 string, c8 string, c9 string")
    lines = [r["value"] for r in writers.agp_lines(rows, "2020-01-01").orderBy("object", "part_number").collect()]
    assert lines[0] == "##agp-version 2.0" and lines[-1] == "test1\t1\t1000\t1\tW\tcontig1\t1\t1000\t+"


def test_config():
    c = parse_config("K=31 # odd\nSAMPLING_RATIO = 0.5\nUNKNOWN=x\nMAX_GAP=\"900\"\n")
    assert (c.k, c.sampling_ratio, c.max_gap, c.min_n) == (31, 0.5, 900, 10)


def test_stream_of_headers(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("2024-01-01 00:00:01", "@a#1_2_3/1"), ("2024-01-01 00:00:02", "@a#1_2_3/1"), ("2024-01-01 00:07:00", "@b#1_2_3/1"), ("2024-01-01 00:00:05", "junk")], "ts string, value string").selectExpr("to_timestamp(ts) ts", "value").write.parquet(str(src))
    lines = spark.readStream.schema("ts timestamp, value string").parquet(str(src))
    q = stream.parse_stream(lines).writeStream.format("memory").queryName("heads").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["read_name"] for r in spark.table("heads").collect()) == ["a", "b"]
    batch = stream.barcode_counts(spark.table("heads"))
    assert sorted(r["n"] for r in batch.collect()) == [1, 1]
