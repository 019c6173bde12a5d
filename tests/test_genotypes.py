"""The data source of genotype tables against the text reader, and its odd files."""

import gzip
import json

import pytest

from haploweave.plans import synth
from haploweave.sources import genotypes, vcf
from test_goldens import VCF


def rows(df):
    return sorted((r["chrom"], r["pos"], tuple(r["calls"])) for r in df.collect())


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    return [r["line"] for r in synth.vcf_lines(spark, sf_dir, True).collect()]


@pytest.mark.parametrize("split", [1000, 1 << 20])
def test_files_of_a_folder(spark, lines, tmp_path, split):
    """Three files, one of them compressed, one with its individuals in another order and its last line open; ranges that cut lines anywhere."""
    head, body = [x for x in lines if x.startswith("#")], [x for x in lines if not x.startswith("#")]
    turn = lambda x: "\t".join(x.split("\t")[:9] + x.split("\t")[9:][::-1])
    (tmp_path / "a.vcf").write_text("\n".join([*head, *body[:80]]) + "\n")
    (tmp_path / "b.vcf").write_text("\n".join([head[0], turn(head[1]), "", *(turn(x) for x in body[80:150])]))
    (tmp_path / "c.vcf.gz").write_bytes(gzip.compress("\n".join(head).encode() + b"\n") + gzip.compress("\n".join(body[150:]).encode()))
    (tmp_path / "_SUCCESS").write_text("no site")
    (tmp_path / "d.vcf").write_text("")
    whole = spark.createDataFrame([(x,) for x in lines], "line string")
    assert rows(genotypes.read(spark, str(tmp_path), split=split)) == rows(vcf.scan(whole))
    ids = spark.createDataFrame([("S3",), ("S1",), ("nobody",)], "sample string")
    assert rows(genotypes.read(spark, f"file:{tmp_path}", ids, split)) == rows(vcf.scan(whole, ids))


def test_every_split_once():
    """Wherever a range ends, each line is read by one task."""
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".vcf") as f:
        text = ("\n".join([*VCF, "", "1\tx"]) + "\n").encode()
        f.write(text)
        f.flush()
        for split in range(1, len(text) + 1, 7):
            parts = genotypes._Reader({"path": f.name, "split": str(split)}).partitions()
            assert b"".join(x for p in parts for x in genotypes._lines(p)) == text


def test_odd_files(spark, tmp_path):
    path = tmp_path / "g.vcf"
    head = "\t".join([*vcf.FIXED, "S0", "S1"])
    path.write_text(f"{head}\n1\t5\t.\tA\tG\t.\t.\t.\tGT\t0|1\n1\tx\t.\tA\tG\t.\t.\t.\tGT\t0|1\t1|1\n")
    assert sorted((r["pos"] or 0, r["calls"]) for r in genotypes.read(spark, str(path)).collect()) == [(0, ["0|1", "1|1"]), (5, ["0|1", None])]
    path.write_text(head)
    assert genotypes.read(spark, str(path)).count() == 0
    read = lambda **o: genotypes._Reader({"path": str(tmp_path), **o}).partitions()
    with pytest.raises(ValueError, match="no individual"):
        read(samples=json.dumps(["nobody"]))
    (tmp_path / "h.vcf").write_text("\t".join([*vcf.FIXED, "S0"]))
    with pytest.raises(ValueError, match="lacks"):
        read()
    (tmp_path / "h.vcf").write_text("1\t5")
    with pytest.raises(ValueError, match="no header"):
        read()
    with pytest.raises(ValueError, match="no input"):
        genotypes._Reader({})
    with pytest.raises(FileNotFoundError):
        genotypes._Reader({"path": str(tmp_path / "none")}).partitions()
