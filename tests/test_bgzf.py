"""Block-gzip files: ranges, reading by many tasks, writing, headers that end early."""

from __future__ import annotations

import gzip
import io
import os
import random

import pyarrow as pa
import pytest

from varfold.operators import variants as va
from varfold.sources import bgzf, vcf

HEADER = '##fileformat=VCFv4.2\n##INFO=<ID=CSQ,Number=.,Type=String,Description="Annotations. Format: gene|impact|AF">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\n'


def record(i: int) -> str:
    return f"chr{1 + i % 22}\t{1000 + i}\trs{i * 7919 % 1000003}\tA\tC\t50\tPASS\tCSQ=G{i % 97}|LOW|0.{i % 90 + 10}\tGT:DP:AD\t{'0/1' if i % 3 else '1/1'}:{20 + i % 60}:{5 + i % 7},{8 + i % 11}\n"


def written(path, text: str, size: int = bgzf.BLOCK_TEXT, end: bool = True) -> str:
    data = text.encode()
    blocks = [bgzf.block(data[i : i + size]) for i in range(0, len(data), size)]
    path.write_bytes(b"".join(blocks) + (bgzf.END_BLOCK if end else b""))
    return str(path)


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    """A file of about 200 blocks, and its text."""
    text = HEADER + "".join(map(record, range(60_000)))
    size = len(text) // 200
    path = tmp_path_factory.mktemp("big") / "calls.vcf.gz"
    return written(path, text, size), text


def test_blocks_are_gzip(big):
    path, text = big
    with gzip.open(path, "rt") as f:
        assert f.read() == text
    packed = b"".join(bgzf.packed(iter([b"ab\n" * 50_000, b"", b"x"])))
    assert gzip.decompress(packed) == b"ab\n" * 50_000 + b"x" and packed.endswith(bgzf.END_BLOCK)
    noise = random.Random(1).randbytes(bgzf.BLOCK_TEXT)  # what can't be packed still fits a block
    assert gzip.decompress(bgzf.block(noise)) == noise and bgzf.block_size(bgzf.block(noise)) == len(bgzf.block(noise))


@pytest.mark.parametrize("split", [1, 37, 500, 4096, 1 << 20])
@pytest.mark.parametrize("size", [1, 5, 64, 3000])
def test_ranges_have_each_line_once(tmp_path, split, size):
    rnd = random.Random(split * size)
    lines = ["".join(rnd.choice("abc\té") for _ in range(rnd.choice([0, 1, 3, 9, 40]))) for _ in range(60)]
    for text in ("\n".join(lines) + "\n", "\n".join(lines) + "\nlast", "\n\n\n", "one line", ""):
        for end in (True, False):
            path = written(tmp_path / "x.gz", text, size, end)
            length, got = os.path.getsize(path), []
            for start in range(0, length, split):
                with pa.OSFile(path) as f:
                    got += [r for t in bgzf.text_of_range(f, length, start, min(start + split, length)) if t for r in bgzf.lines_of(t).column(0).to_pylist()]
                if split == 1 and start > 3000:
                    break
            want = text.removesuffix("\n").split("\n") if text else []
            assert got == want[: len(got)] and (len(got) == len(want) or split == 1)


def test_false_headers_are_passed_over():
    trap = bgzf.MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0\x20\0" + b"x" * 40
    data = trap + bgzf.block(b"one\n") + bgzf.block(b"two\n")
    assert bgzf.first_block(data, True) == len(trap)
    assert bgzf.first_block(trap * 3, True) is None
    assert bgzf.block_size(gzip.compress(b"plain")) is None


def test_one_file_is_read_by_many_tasks(spark, big):
    path, text = big
    df = vcf.read_lines(spark, path, split_bytes=40_000)
    assert df.rdd.getNumPartitions() == -(-os.path.getsize(path) // 40_000) > 10
    counts = [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(counts) > 10 and sum(counts) == text.count("\n")
    assert [r.value for r in df.collect()] == text.splitlines()
    plain = os.path.join(os.path.dirname(path), "plain.vcf")
    with open(plain, "w") as f:
        f.write(text)
    assert sorted(map(tuple, va.read_germline_variants(spark, path, split_bytes=40_000).collect())) == sorted(map(tuple, va.read_germline_variants(spark, plain).collect()))


def test_folder_of_all_kinds(spark, tmp_path):
    written(tmp_path / "a.vcf.gz", HEADER + record(1), 100)
    (tmp_path / "b.vcf").write_text(HEADER + record(2))
    with gzip.open(tmp_path / "c c.vcf.gz", "wt") as f:
        f.write(HEADER + record(3))
    written(tmp_path / "d é.vcf.bgz", HEADER + record(4))
    written(tmp_path / "empty.vcf.gz", "")
    got = {r.POS for r in vcf.read_vcf(spark, str(tmp_path)).collect()}
    assert got == {1001, 1002, 1003, 1004}
    assert {r.POS for r in vcf.read_vcf(spark, f"{tmp_path}/*.bgz").collect()} == {1004}
    assert vcf.read_csq_keys(spark, str(tmp_path)) == ["gene", "impact", "AF"]
    spark.dataSource.register(bgzf.BlockGzip)
    alone = spark.read.format("block_gzip").load(str(tmp_path / "a.vcf.gz"))
    assert alone.columns == ["value"] and alone.count() == HEADER.count("\n") + 1
    only = tmp_path / "only"
    only.mkdir()
    for k in range(3):
        written(only / f"{k}.vcf.gz", record(k), 50)
    assert spark.read.format("block_gzip").load(str(only)).count() == 3


def test_written_files_are_whole(spark, tmp_path):
    lines = spark.createDataFrame([(record(i).strip(),) for i in range(3000)] + [(None,)], "value string").repartition(4)
    out = str(tmp_path / "out")
    bgzf.write_blocks(lines, HEADER, out)
    files = sorted(f for f in os.listdir(out) if not f.endswith(".crc"))
    assert len(files) == 4 and all(f.startswith("part-") and f.endswith(".vcf.gz") for f in files)
    for f in files:
        with gzip.open(f"{out}/{f}", "rt") as g:
            assert g.read().startswith(HEADER)
    assert {r.POS for r in vcf.read_vcf(spark, out).collect()} == {1000 + i for i in range(3000)}
    bgzf.write_blocks(lines.limit(5), HEADER, out)  # more files beside them
    assert vcf.read_vcf(spark, out).count() == 3005
    lines.limit(7).write.format("block_gzip").mode("overwrite").option("header", HEADER).save(out)
    assert vcf.read_vcf(spark, out).count() == 7


def test_failed_writes_leave_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    out = str(tmp_path / "out")
    bad = spark.range(100).repartition(3).select(F.when(F.col("id") == 50, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="no"):
        bgzf.write_blocks(bad, HEADER, out)
    assert [f for f in os.listdir(out) if "part" in f] == []


def test_broken_files_are_refused(tmp_path):
    path = tmp_path / "x.gz"
    whole = bgzf.block(b"abc\n" * 100) + bgzf.block(b"def\n" * 100)
    path.write_bytes(whole[:-5])
    with pa.OSFile(str(path)) as f, pytest.raises(ValueError, match="breaks off"):
        list(bgzf.text_of_range(f, len(whole) - 5, 0, len(whole)))
    flipped = bytearray(whole)
    flipped[-6] ^= 1
    path.write_bytes(flipped)
    with pa.OSFile(str(path)) as f, pytest.raises(ValueError, match="checksum"):
        list(bgzf.text_of_range(f, len(whole), 0, len(whole)))


@pytest.mark.parametrize("kind", ["plain", "gzip", "blocks"])
def test_heads_end_where_the_header_does(monkeypatch, tmp_path, kind):
    """However many records follow, no more is read; they may even be broken."""
    long = HEADER.replace("#CHROM", "".join(f"##contig=<ID=c{i}>\n" for i in range(20_000)) + "#CHROM")
    body = "".join(map(record, range(100_000)))
    for header in (HEADER, long):
        text = (header + body).encode()
        data = {"plain": text, "gzip": gzip.compress(text), "blocks": b"".join(bgzf.packed(iter([text])))}[kind]
        data = data[: len(data) * 3 // 4] + b"\0" * 1000
        read = []

        class Watched(io.BytesIO):
            def read(self, n=-1):
                got = super().read(n)
                read.append(len(got))
                return got

        class System:
            def open_input_file(self, path):
                return Watched(data)

        monkeypatch.setattr(bgzf, "opened", lambda path: (System(), path))
        blocked, head = bgzf.head_of("x")
        assert head.decode() == header and blocked == (kind == "blocks")
        assert sum(read) <= len(header) + 2 * bgzf.HEAD < len(data)
    for text in ("", "#only\n", "#no end", "rec\n", "#a\nrec"):
        data = {"plain": text.encode(), "gzip": gzip.compress(text.encode()), "blocks": b"".join(bgzf.packed(iter([text.encode()])))}[kind]
        want = "#a\n" if text == "#a\nrec" else "" if text == "rec\n" else text
        assert bgzf.head_of("x")[1].decode() == want


def test_file_systems_that_arrow_does_not_know(spark, tmp_path, monkeypatch):
    """Spark's own readers take over."""
    path = written(tmp_path / "a.vcf.gz", HEADER + record(1) + record(2), 100)

    def unknown(path):
        raise pa.ArrowInvalid("Unrecognized filesystem type")

    monkeypatch.setattr(vcf, "opened", unknown)
    assert vcf.read_csq_keys(spark, path) == ["gene", "impact", "AF"]
    assert {r.POS for r in vcf.read_vcf(spark, path).collect()} == {1001, 1002}
    assert vcf.read_lines(spark, path)._jdf.queryExecution().executedPlan().toString().count("block_gzip") == 0
