"""Runs over the list of chunks: stopped, taken up again, and compared with scoring in one go."""

import pytest

from haploweave.__main__ import main
from haploweave.operators import blocks, edges
from haploweave.plans import flows, run, synth
from haploweave.sources import sinks
from test_flows import read

LONGEST, MOST = 30, 140


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """A graph of two chromosomes, of which one is short."""
    at = tmp_path_factory.mktemp("graph")
    graph = synth.graph(spark, sf_dir).where("r > 0.001")
    both = graph.selectExpr("'1' AS chrom", "*").unionByName(graph.where("loc_b < 80").selectExpr("'X' AS chrom", "*"))
    sinks.write_by_left_end(both, f"{at}/edges.parquet", 4, ["chrom"])
    return f"{at}/edges.parquet"


@pytest.fixture(scope="module")
def flat(spark, stored):
    """The first chromosome alone."""
    path = stored.replace("edges.parquet", "flat.parquet")
    spark.read.parquet(stored).where("chrom = '1'").drop("chrom").write.parquet(path)
    return path


def in_one_go(spark, path, chrom, model, value):
    graph = flows.read_graph(spark, path).where(f"chrom = '{chrom}'").drop("chrom")
    dp = flows.score(graph, model, LONGEST, value, distance=10)
    return sorted(tuple(r) for r in blocks.blocks(dp).collect()), blocks.best_total(dp).first()["opt"]


def results(out):
    return sorted((int(a), int(b)) for a, b in read(out / "result" / "blocks.txt")), float(read(out / "result" / "score.txt")[0][0])


def test_equals_one_go(spark, flat, stored, tmp_path):
    run.whole(spark, flat, str(tmp_path), "modularity", LONGEST, MOST)
    assert len(list((tmp_path / "chunks").iterdir())) > 1
    found, best = in_one_go(spark, stored, "1", "modularity", None)
    ours, total = results(tmp_path)
    assert ours == found
    assert total == pytest.approx(best, abs=1e-9)
    assert spark.read.parquet(str(tmp_path / "result" / "summary.parquet")).first()["n_blocks"] == len(found)


def test_stopped_and_taken_up(spark, flat, stored, tmp_path, monkeypatch):
    """A stop within a chunk leaves half of its files; the next run makes that chunk again, and none before it."""
    args, out = ("background", LONGEST, MOST, None, 10), tmp_path / "out"
    write, calls = sinks.write_optimum, []

    def stops(dp, scores, breaks, *more):
        calls.append(scores)
        if len(calls) == 2:
            sinks.write_text(dp, scores, [dp["pos"].cast("string")])
            raise KeyboardInterrupt
        write(dp, scores, breaks, *more)

    monkeypatch.setattr(sinks, "write_optimum", stops)
    with pytest.raises(KeyboardInterrupt):
        run.whole(spark, flat, str(out), *args)
    assert not (out / "result").exists()
    notes = {p: p.stat().st_mtime_ns for p in (out / "_done").rglob("*.json")}
    assert len(notes) == 2  # the split and the first chunk
    run.whole(spark, flat, str(out), *args)
    assert calls[2] == calls[1] and len(set(calls)) == len(calls) - 1
    assert {p: p.stat().st_mtime_ns for p in notes} == notes
    found, best = in_one_go(spark, stored, "1", "background", None)
    assert results(out) == (found, pytest.approx(best, abs=1e-9))
    n = len(calls)
    run.whole(spark, flat, str(out), *args)
    assert len(calls) == n
    with pytest.raises(ValueError, match="was made with"):
        run.whole(spark, flat, str(out), "background", LONGEST, MOST, None, 11)


def test_program(spark, stored, tmp_path):
    (tmp_path / "p.txt").write_text("0.03")
    assert main(["run", "-i", stored, "-o", str(tmp_path / "out"), "-m", "constant", "-l", str(LONGEST), "-v", str(MOST), "--penalty", str(tmp_path / "p.txt")], spark) == 0
    assert results(tmp_path / "out" / "chrom=X")[0] == in_one_go(spark, stored, "X", "constant", 0.03)[0]


def test_odd_graphs(spark, tmp_path):
    """No edges: no chunks and no result. A pair that occurs twice is an error."""
    one = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5)], "loc_a long, loc_b long, r double")
    one.limit(0).write.parquet(f"{tmp_path}/none.parquet")
    run.whole(spark, f"{tmp_path}/none.parquet", f"{tmp_path}/o", "constant", 10, 10, 0.1)
    assert not (tmp_path / "o" / "result").exists()
    edges.canonical(one).write.parquet(f"{tmp_path}/two.parquet")
    with pytest.raises(ValueError, match="twice"):
        run.whole(spark, f"{tmp_path}/two.parquet", f"{tmp_path}/p", "constant", 10, 10, 0.1)
