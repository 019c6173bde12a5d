import pytest

from haploweave.__main__ import main
from haploweave.plans import flows, synth
from haploweave.sources import text
from haploweave.streaming import edges as stream
from test_goldens import LINES, VCF


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines))  # no line break at the end
    return str(path)


def read(folder):
    return [x.split() for p in sorted(folder.rglob("part-*")) if ".crc" not in p.name for x in p.read_text().splitlines()]


def test_from_genotypes_to_blocks(spark, tmp_path, sf_dir):
    source = write(tmp_path / "in" / "g.vcf", [r["line"] for r in synth.vcf_lines(spark, sf_dir, True).where("line LIKE '#%' OR rand(1) < 0.3").collect()])
    out = tmp_path / "out"
    assert main(["correlate", "-i", source, "-o", str(out), "-l", "50", "-p", "--compat", "-r2", "0.001"], spark) == 0
    assert all(len(x[2].split(".")[1]) == 6 for x in read(out / "edges.txt"))
    assert main(["split", "-i", f"{out}/edges.parquet", "-o", str(out / "s"), "-m", "modularity", "-l", "50", "-v", "100"], spark) == 0
    chunks = [int(x[0]) for x in read(out / "s" / "chunks.txt")]
    assert chunks == sorted(chunks, reverse=True)
    for model, extra in (("constant", ["--penalty", f"{out}/penalty.txt"]), ("modularity", [])):
        a, b = out / f"{model}1", out / f"{model}2"
        base = ["score", "-i", f"{out}/edges.parquet", "-m", model, "-l", "50", *extra]
        assert main([*base, "-o", str(a)], spark) == 0
        assert main([*base, "-o", str(b), "-v", "100"], spark) == 0
        assert read(a / "blocks.txt") == read(b / "blocks.txt")
    with pytest.raises(ValueError, match="needs a penalty"):
        flows.score(flows.read_graph(spark, f"{out}/edges.parquet"), "chi", 50)


def test_shrinkage_flow(spark, tmp_path):
    source = write(tmp_path / "g.vcf", VCF)
    full = write(tmp_path / "map.txt", [f"rs{p} {p} {p / 1e5}" for p in range(1000, 7000, 1000)] + ["rs1000 1000 0.01"])
    graph, removed, value, _ = flows.correlate(spark, source, 5000, genetic_map=full, effective_size=100.0, phased=True)
    found = {(r["loc_a"], r["loc_b"]): r["r"] for r in graph.collect()}
    assert found[1000, 2000] == pytest.approx(0.143520, abs=1e-6)
    assert {r["pos"]: r["reason"] for r in removed.collect()} == {4000: "multiallelic", 5000: "no_variation"}
    assert value == pytest.approx(3.841459 / 8, abs=1e-6)
    with pytest.raises(ValueError, match="missing from the map"):
        flows.correlate(spark, source, 5000, genetic_map=write(tmp_path / "short.txt", ["rs 1000 0.1"]), effective_size=100.0)


def test_selected_individuals(spark, tmp_path):
    source, ids = write(tmp_path / "g.vcf", VCF), write(tmp_path / "ids.txt", ["S3", "S1", "nobody"])
    _, _, value, _ = flows.correlate(spark, source, 5000, ids=ids, phased=True)
    assert value == pytest.approx(3.841459 / 4, abs=1e-6)
    with pytest.raises(ValueError, match="no individual"):
        flows.correlate(spark, source, 5000, ids=write(tmp_path / "none.txt", ["nobody"]), phased=True)


def test_combine(spark, tmp_path):
    a = write(tmp_path / "a" / "1.txt", LINES)
    b = write(tmp_path / "b" / "1.txt", ["200 100 0.95", "100 600 0.01"])
    assert main(["combine", "-i", f"{a},{b}", "-o", str(tmp_path / "out")], spark) == 0
    found = {(r["loc_a"], r["loc_b"]): r["r"] for r in spark.read.parquet(str(tmp_path / "out" / "edges.parquet")).collect()}
    assert len(found) == 7
    assert (found[100, 200], found[100, 600]) == (0.95, 0.02)
    assert text.read_edges(spark, f"{tmp_path}/a,{tmp_path}/b").count() == 10


def test_number_files(spark, tmp_path):
    assert text.read_value(spark, write(tmp_path / "p.txt", ["0.25"])) == 0.25
    with pytest.raises(Exception):
        text.read_value(spark, str(tmp_path / "missing.txt"))


def test_stream(spark, tmp_path):
    folder = tmp_path / "edges"
    write(folder / "1.txt", LINES[:4])
    query = stream.stream_degrees(spark, str(folder), "skip").writeStream.format("memory").queryName("degrees").outputMode("complete").start()
    try:
        query.processAllAvailable()
        write(folder / "2.txt", [*LINES[4:], "not an edge"])
        query.processAllAvailable()
        found = {r["pos"]: r["k"] for r in spark.table("degrees").collect()}
    finally:
        query.stop()
    assert found == {100: pytest.approx(1.72), 200: pytest.approx(1.6), 300: pytest.approx(1.55), 400: pytest.approx(0.65), 500: pytest.approx(1.1), 600: pytest.approx(0.52)}
    odd = stream.stream_malformed(spark, str(folder)).writeStream.format("memory").queryName("odd").start()
    try:
        odd.processAllAvailable()
        assert [r["line"] for r in spark.table("odd").collect()] == ["not an edge"]
    finally:
        odd.stop()


def two_chromosomes(spark, sf_dir):
    """A genotype table whose sites are on two chromosomes, at the same positions."""
    lines = [r["line"] for r in synth.vcf_lines(spark, sf_dir, True).collect()]
    out = []
    for x in lines:
        f = x.split("\t")
        if not x.startswith("#"):
            f[0], f[1] = ("1", f[1]) if int(f[1]) % 2 else ("X", str(int(f[1]) - 1))
        out.append("\t".join(f))
    return out


def test_chromosomes_apart(spark, tmp_path, sf_dir):
    """Two chromosomes in one run give what each gives alone."""
    lines = two_chromosomes(spark, sf_dir)
    found = {}
    for name, kept in (("both", ("1", "X")), ("1", ("1",)), ("X", ("X",))):
        source = write(tmp_path / f"{name}.vcf", [x for x in lines if x.startswith("#") or x.split("\t")[0] in kept])
        out = tmp_path / name
        assert main(["correlate", "-i", source, "-o", str(out), "-l", "60", "-p", "-r2", "0.001"], spark) == 0
        for model, extra in (("constant", ["--penalty", f"{out}/penalty.txt"]), ("modularity", []), ("background", [])):
            if model == "background":
                continue
            assert main(["score", "-i", f"{out}/edges.parquet", "-o", str(out / model), "-m", model, "-l", "60", *extra], spark) == 0
            for c in kept:
                found[name, model, c] = read(out / model / "blocks.txt" / f"chrom={c}")
        assert main(["split", "-i", f"{out}/edges.parquet", "-o", str(out / "s"), "-m", "modularity", "-l", "60", "-v", "90"], spark) == 0
        for c in kept:
            found[name, "chunks", c] = read(out / "s" / "chunks.txt" / f"chrom={c}")
            found[name, "sites", c] = read(out / "s" / "sites.txt" / f"chrom={c}")
    for what in ("constant", "modularity", "chunks", "sites"):
        for c in ("1", "X"):
            assert found["both", what, c] == found[c, what, c] != []


def test_chunks_one_after_another(spark, tmp_path, sf_dir):
    """Scoring chunk by chunk from the right, each from the files of the one before, equals the whole run."""
    source = write(tmp_path / "g.vcf", [r["line"] for r in synth.vcf_lines(spark, sf_dir, True).collect()])
    out = tmp_path / "out"
    assert main(["correlate", "-i", source, "-o", str(out), "-l", "40", "-p", "-r2", "0.001"], spark) == 0
    flat = spark.read.parquet(f"{out}/edges.parquet").drop("chrom")
    flat.write.parquet(f"{out}/flat.parquet")
    base = ["-i", f"{out}/flat.parquet", "-m", "modularity", "-l", "40"]
    assert main(["split", *base, "-o", str(out / "s"), "-v", "150"], spark) == 0
    assert main(["score", *base, "-o", str(out / "whole")], spark) == 0
    chunks = text.read_chunks(spark, f"{out}/s/chunks.txt").orderBy("start_bp", ascending=False).collect()
    assert len(chunks) > 1
    before = None
    for k, c in enumerate(chunks):
        extra = ["--resume", str(before)] if before else []
        before = out / f"c{k}"
        final = ["-f"] if k == len(chunks) - 1 else []
        assert main(["score", *base, "-o", str(before), "-s", str(c["start_bp"]), "-e", str(c["end_bp"]), "-b", str(c["buffer_end_bp"]), "--sites", f"{out}/s/sites.txt", "--degree", f"{out}/s/degree.txt", *extra, *final], spark) == 0
        assert (before / "blocks.txt").exists() == bool(final)
    assert read(before / "blocks.txt") == read(out / "whole" / "blocks.txt")
    ours, whole = ({int(p): float(x) for p, x in read(at / "opt_scores.txt")} for at in (before, out / "whole"))
    assert ours == pytest.approx(whole, abs=1e-9)


def test_read_back(spark, tmp_path, sf_dir):
    """Readers of what the writers write."""
    from haploweave.operators import blocks, edges
    from haploweave.sources import sinks

    graph = synth.items(spark, sf_dir)
    line, chunks = flows.split(graph, 60, 150)
    degree = edges.normalized_degree(graph)
    sinks.write_positions(line, f"{tmp_path}/sites")
    sinks.write_chunks(chunks, f"{tmp_path}/chunks")
    sinks.write_degree(degree, f"{tmp_path}/degree")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(text.read_positions(spark, f"{tmp_path}/sites"), line.select("pos"))
    assert same(text.read_chunks(spark, f"{tmp_path}/chunks"), chunks)
    assert same(text.read_degree(spark, f"{tmp_path}/degree", 20, 90), degree.where("pos BETWEEN 20 AND 90").select("pos", "k_norm"))
    dp = flows.score(graph, "constant", 20, 0.05)
    sinks.write_optimum(dp, f"{tmp_path}/scores", f"{tmp_path}/breaks")
    sinks.write_blocks(blocks.blocks(dp), f"{tmp_path}/blocks")
    assert same(text.read_optimum(spark, f"{tmp_path}/scores", f"{tmp_path}/breaks"), dp.select("pos", "opt", "brk"))
    assert same(text.read_blocks(spark, f"{tmp_path}/blocks"), blocks.blocks(dp))
    sinks.write_by_chunk(edges.by_chunk(graph, chunks, 3, 60), f"{tmp_path}/dealt")
    assert spark.read.parquet(f"{tmp_path}/dealt").count() == edges.by_chunk(graph, chunks, 3, 60).count()


def test_six_digits(spark):
    from haploweave.sources.sinks import six
    from pyspark.sql import functions as F

    found = [r[0] for r in spark.createDataFrame([(0.123456789,), (1234567.0,), (2.0,)], "x double").select(six(F.col("x"))).collect()]
    assert [float(x) for x in found] == [0.123457, 1234570.0, 2.0]


def test_consensus_program(spark, tmp_path, sf_dir):
    from haploweave.operators import consensus
    from haploweave.plans import queries
    from haploweave.sources import sinks

    sets = synth.block_sets(spark, sf_dir)
    for p in ("P0", "P1", "P2", "P3"):
        sinks.write_blocks(sets.where(f"pop = '{p}'"), f"{tmp_path}/{p}")
    given = ",".join(f"{p}={tmp_path}/{p}" for p in ("P0", "P1", "P2", "P3"))
    assert main(["consensus", "-i", given, "-o", str(tmp_path / "out"), "-b", str(queries.BUFFER), "-w", "200"], spark) == 0
    found = [(float(a), float(b)) for a, b in read(tmp_path / "out" / "consensus.txt")]
    assert found == sorted(found)
    assert found == sorted((r["start"], r["stop"]) for r in consensus.repaired(sets, queries.BUFFER, queries.REACH).collect())


def test_last_line_of_a_map(spark, tmp_path):
    """By file name, then line, however the files are read."""
    for k in range(4):
        write(tmp_path / "map" / f"{k}.txt", [f"rs 7 {k}.{i}" for i in range(5)] + [f"rs {k} 1"])
    found = {r["pos"]: r["cm"] for r in text.parse_genetic_map(text.read_placed(spark, str(tmp_path / "map"))).collect()}
    assert found[7] == 3.4
