"""VCF reading, filters, genotypes and arms."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from varfold.operators import variants as va
from varfold.sources import arms, vcf
from varfold.streaming.vcf import stream_germline_variants

HEADER = """##fileformat=VCFv4.2
##INFO=<ID=CSQ,Number=.,Type=String,Description="Annotations. Format: gene|impact|AF">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
"""


def line(chrom, pos, info, gt="0/1", dp="60", ad="30,30", fmt="GT:DP:AD"):
    return f"{chrom}\t{pos}\t.\tA\tC\t50\tPASS\t{info}\t{fmt}\t{gt}:{dp}:{ad}\t1/1:9:0,9\n"


LINES = [
    line("chr1", 100000000, "NS=3;CSQ=BRCA1|HIGH|0.1"),
    line("chr1", 123399999, "CSQ=G|LOW|0.06,H|HIGH|0.01", "1|1", "40", "1,39"),
    line("chr1", 123400000, "CSQ=G|LOW|0.3", "./1"),
    line("chr1", 999999999, "CSQ=G|LOW|0.3"),
    line("chrUn", 5, "CSQ=G|LOW|0.3"),
    line("chr2", 5, "CSQ=G|LOW|0.05"),
    line("chr2", 6, "CSQ=G|LOW|"),
    line("chr2", 7, "CSQ=G|LOW|0.1&0.2"),
    line("chr2", 8, "CSQ=G|LOW|NaN"),
    line("chr2", 9, "NS=2"),
    line("chr2", 10, "CSQ="),
    line("chr2", 11, "CSQ=G"),
    line("chr2", 12, "CSQ=G|LOW|0.3", "0/0"),
    line("chr2", 13, "CSQ=G|LOW|0.3", "1/2"),
    line("chr2", 14, "CSQ=G|LOW|0.3", "2/2"),
    line("chr2", 15, "CSQ=G|LOW|0.3", "1"),
    line("chr2", 16, "CSQ=G|LOW|0.3", "./."),
    line("chr2", 17, "CSQ=G|LOW|0.3", "1/1", ".", "3,17"),
]
WANT = {
    ("chr1", 100000000, "p", "hetalt", 60, 30),
    ("chr1", 123399999, "p", "homalt", 40, 39),
    ("chr1", 123400000, "q", "hetalt", 60, 30),
    ("chr1", 999999999, "q", "hetalt", 60, 30),
    ("chrUn", 5, None, "hetalt", 60, 30),
    ("chr2", 13, "p", "hetalt", 60, 30),
    ("chr2", 17, "p", "homalt", 20, 17),
}


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "in.vcf"
    path.write_text(HEADER + "".join(LINES))
    return str(path)


def as_set(df):
    return {(r.chrom, r.pos, r.arm, r.genotype, r.depth, r.alt) for r in df.collect()}


def test_collects_common_germline_variants(spark, file):
    got = va.read_germline_variants(spark, file)
    assert as_set(got) == WANT
    assert {r.vaf for r in got.where("pos = 17").collect()} == {0.85}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert va.malformed_af(vcf.read_vcf(spark, file), ["gene", "impact", "AF"]).first()[0] == 1


def test_gzip_second_sample_and_threshold(spark, file, tmp_path):
    packed = str(tmp_path / "in.vcf.gz")
    with gzip.open(packed, "wt") as f:
        f.write(HEADER + "".join(LINES))
    assert as_set(va.read_germline_variants(spark, packed)) == WANT
    other = va.read_germline_variants(spark, file, least_af=0.2, sample=1).collect()
    assert {(r.genotype, r.depth, r.alt) for r in other} == {("homalt", 9, 9)} and len(other) == 9


def test_reads_of_every_alternative_allele(spark, tmp_path):
    path = str(tmp_path / "many")
    lines = spark.createDataFrame([(line("chr1", 5, "CSQ=G|LOW|0.3", "1/2", "60", "10,20,9").strip(),), (line("chr1", 6, "CSQ=G|LOW|0.3", "0/1", "7", ".").strip(),)], "value string")
    vcf.write_vcf(lines, HEADER, path)
    first = {r.pos: (r.depth, r.alt) for r in va.read_germline_variants(spark, path).collect()}
    every = {r.pos: (r.depth, r.alt) for r in va.read_germline_variants(spark, path, every_alt=True).collect()}
    assert first == {5: (60, 20), 6: (7, None)} and every == {5: (39, 29), 6: (7, None)}
    plan = va.read_germline_variants(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_header(spark, file, tmp_path):
    assert vcf.read_csq_keys(spark, file) == ["gene", "impact", "AF"]
    bare = tmp_path / "bare.vcf"
    bare.write_text("##fileformat=VCFv4.2\n" + LINES[0])
    assert vcf.read_csq_keys(spark, str(bare)) is None
    assert va.read_germline_variants(spark, str(bare)).collect() == []
    with pytest.raises(ValueError, match="no field list"):
        vcf.csq_keys("gene|AF")


def test_store_groups_by_chromosome_arm_and_genotype(spark, file):
    rows = va.collected(va.read_germline_variants(spark, file)).collect()
    by = {(r.chrom, r.arm, r.genotype): r.variants for r in rows}
    assert len(by[("chr1", "q", "hetalt")]) == 2
    assert by[("chr1", "p", "homalt")][0].asDict() == {"DP": 40, "alt_DP": 39, "VAF": 39 / 40}


def test_arms(spark):
    rows = [("chr1", 0), ("chr1", 123399999), ("chr1", 123400000), ("chrX", 61000001), ("nope", 1), (None, 1), ("chr1", None), ("chr1", -5)]
    frame = spark.createDataFrame(rows, "chrom string, pos long")
    want = ["p", "p", "q", "q", None, None, None, "p"]
    assert [r[0] for r in frame.select(arms.arm_of("chrom", "pos")).collect()] == want
    joined = arms.with_arm(frame, arms.arm_table(spark)).collect()
    assert sorted(map(str, ((r.chrom, r.pos, r.arm) for r in joined))) == sorted(map(str, ((*r, a) for r, a in zip(rows, want, strict=True))))
    assert arms.reduce_arms(arms.arm_table(spark)).count() == 24
    custom = arms.arm_table(spark, [("z", 0, 10, "q")])
    assert arms.with_arm(spark.createDataFrame([("z", 3)], "chrom string, pos long"), custom).first().arm is None


def test_valid_counts_and_histogram(spark):
    frame = spark.createDataFrame([(1, 2), (1, 2), (3, 2), (-1, 2), (None, 2), (0, 0)], "alt int, depth int")
    assert va.valid_counts(frame).count() == 3
    assert {(r.alt, r.depth, r.weight) for r in va.histogram(frame, ()).collect()} == {(1, 2, 2), (0, 0, 1)}


def test_stream(spark, file, tmp_path):
    found = stream_germline_variants(spark, str(tmp_path), ["gene", "impact", "AF"])
    query = found.writeStream.format("memory").queryName("germline_stream").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert as_set(spark.table("germline_stream")) == WANT
    assert found.isStreaming and F.col
