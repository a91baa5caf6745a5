"""Positional assembly: hand-made fragments, any split size."""

import random

import pytest
from pyspark.sql import functions as F

from microatlas import config
from microatlas.sources import fragments as fr
from microatlas.sources.tables import with_dense_id


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "\n".join([";".join(header), *[";".join(r) for r in rows]]) + "\n"
    path.write_bytes(text.encode("latin-1"))


def edition(folder, n, seed=0, short=0):
    rng = random.Random(seed)
    groups = [rng.choice(["72", "79", "4004", "1"]) for _ in range(n)]
    ident = [("1900", f"c{i}", g, f"Instituição {i} çã") for i, g in enumerate(groups)]
    scores = [("1900", "zz", f"{i}.5", rng.choice(["555", " 555 ", "222"])) for i in range(n)]
    income = [("zz", rng.choice("ABCDEFG")) for _ in range(n - short)]
    write(folder / "a_ident.txt", ["NU_ANO", "CO_CURSO", "CO_GRUPO", "NO_IES"], ident)
    write(folder / "b_scores.txt", ["NU_ANO", "CO_CURSO", "NT_GER", "TP_PRES"], scores)
    write(folder / "deep" / "c_income.txt", ["CO_CURSO", "QE_I05"], income)
    write(folder / "z_other.txt", ["CO_CURSO", "QE_I05", "LIXO"], [("zz", "?", "x")] * n)
    return [
        (i, ident[i][1], groups[i], ident[i][3], scores[i][2], scores[i][3], income[i][1] if i < n - short else None)
        for i in range(n)
    ]


COLUMNS = ["pos", "CO_CURSO", "CO_GRUPO", "NO_IES", "NT_GER", "TP_PRES", "QE_I05"]


@pytest.mark.parametrize("split", ["128m", "700", "4096"])
def test_positions_hold_for_any_split_size(spark, tmp_path, split):
    expected = edition(tmp_path / "e2014", 400, short=37)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows, report = fr.load_editions(spark, {2014: str(tmp_path / "e2014")}, None)
        found = sorted(tuple(r) for r in rows.select(*COLUMNS).collect())
        assert found == sorted(expected)
        assert {r[0] for r in rows.select("NU_ANO").collect()} == {"2014"}
        line = report.first()
        assert (line.menor_fragmento, line.maior_fragmento, line.alinhado) == (363, 400, False)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_course_filter_and_editions(spark, tmp_path):
    expected = {y: edition(tmp_path / f"e{y}", n, seed=y, short=5) for y, n in ((2014, 60), (2017, 90))}
    folders = {y: str(tmp_path / f"e{y}") for y in expected}
    rows, _ = fr.load_editions(spark, folders, tuple(config.COURSE_NAMES))
    found = sorted(tuple(r) for r in rows.select("NU_ANO", *COLUMNS).collect())
    wanted = sorted((str(y), *r) for y, rs in expected.items() for r in rs if r[2] != "1")
    assert found == wanted
    assert set(config.OPTIONAL_COLUMNS) <= set(rows.columns)


def test_an_edition_may_have_no_kept_course(spark, tmp_path):
    edition(tmp_path / "e2014", 30)
    write(tmp_path / "e2017" / "a.txt", ["CO_CURSO", "CO_GRUPO"], [("x", "1")] * 8)
    write(tmp_path / "e2017" / "b.txt", ["CO_CURSO", "QE_I05"], [("x", "A")] * 8)
    folders = {y: str(tmp_path / f"e{y}") for y in (2014, 2017)}
    rows, _ = fr.load_editions(spark, folders, (72, 79, 4004), with_id=True)
    assert {r.NU_ANO for r in rows.collect()} == {"2014"}
    assert sorted(r.id for r in rows.collect()) == list(range(rows.count()))


def test_same_rows_without_broadcast(spark, tmp_path):
    edition(tmp_path / "e2014", 300)
    folders = {2014: str(tmp_path / "e2014")}
    want = sorted(map(tuple, fr.load_editions(spark, folders)[0].collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, fr.load_editions(spark, folders)[0].collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_first_fragment_by_path_wins_and_identification_overrides(spark, tmp_path):
    edition(tmp_path / "e", 5)
    found = fr.fragments_of(spark, fr.discover(spark, str(tmp_path / "e")))
    choice = fr.choose_columns(2014, found)
    owner = {c: n.rsplit("/", 1)[1] for n, cs in choice.taken.items() for c in cs}
    assert owner["QE_I05"] == "c_income.txt"
    assert owner["CO_CURSO"] == owner["CO_GRUPO"] == "a_ident.txt"
    assert not any(n.endswith("z_other.txt") for n in choice.taken)


def test_missing_edition_fails_or_is_reported(spark, tmp_path):
    edition(tmp_path / "e", 5)
    folders = {2014: str(tmp_path / "e"), 2017: str(tmp_path / "none")}
    with pytest.raises(Exception):
        fr.load_editions(spark, folders)
    rows, report = fr.load_editions(spark, folders, None, on_error="skip")
    assert rows.count() == 5
    assert {r.ano: r.situacao == "ok" for r in report.collect()} == {2014: True, 2017: False}
    with pytest.raises(RuntimeError):
        fr.load_editions(spark, {2017: str(tmp_path / "none")}, on_error="skip")


def test_unreadable_fragment_fails_or_is_reported(spark, tmp_path):
    edition(tmp_path / "e", 6)
    (tmp_path / "e" / "broken.txt").write_bytes(b"")
    found = fr.discover(spark, str(tmp_path / "e"))
    missing = [*found, f"file:{tmp_path}/e/gone.txt"]
    with pytest.raises(Exception):
        fr.fragments_of(spark, missing)
    failed = []
    kept = fr.fragments_of(spark, missing, "skip", failed)
    assert len(failed) == 1 and failed[0].endswith("gone.txt")
    assert {f.name.rsplit("/", 1)[1] for f in kept if f.columns} == {"a_ident.txt", "b_scores.txt", "c_income.txt", "z_other.txt"}
    rows, report = fr.load_editions(spark, {2014: str(tmp_path / "e")}, None, on_error="skip")
    assert rows.count() == 6 and report.first().fragmentos_com_erro == 0


def test_edition_without_identification_is_an_error(spark, tmp_path):
    write(tmp_path / "e" / "x.txt", ["CO_CURSO", "QE_I05"], [("a", "b")])
    with pytest.raises(ValueError):
        fr.load_editions(spark, {2014: str(tmp_path / "e")})


def test_dense_ids_follow_edition_and_position(spark):
    rows = spark.range(0, 200_000, 3).select(
        (F.col("id") % 2 + 2014).cast("int").alias("nu_ano"), F.col("id").alias("pos")
    )
    out = with_dense_id(rows).collect()
    ordered = sorted(out, key=lambda r: (r.nu_ano, r.pos))
    assert [r.id for r in ordered] == list(range(len(ordered)))


def in_cluster(spark, number, build, most="128m"):
    """Run one step as a cluster of another size would split the files."""
    own = {"openCostInBytes": "1", "maxPartitionBytes": most, "minPartitionNum": str(number)}
    with fr.set_conf(spark, **own):
        return build()


def choices_of(spark, folder):
    return [fr.choose_columns(2014, fr.fragments_of(spark, fr.discover(spark, str(folder))))]


def test_steps_may_see_clusters_of_different_sizes(spark, tmp_path):
    expected = edition(tmp_path / "e2014", 4000, short=100)
    choices = in_cluster(spark, 3, lambda: choices_of(spark, tmp_path / "e2014"))
    layer = in_cluster(spark, 7, lambda: fr.lay_out(spark, fr.parts_of(choices)), "4096")
    found = in_cluster(spark, 5, lambda: sorted(tuple(r) for r in fr.assemble(spark, choices, layer=layer).select(*COLUMNS).collect()))
    assert found == sorted(expected)


def test_rows_that_are_not_placed_are_an_error(spark, tmp_path):
    """A layer of other splits than the counted ones, one short of a row, and a doubled one."""
    edition(tmp_path / "e2014", 400)
    parts = fr.parts_of(choices_of(spark, tmp_path / "e2014"))
    layer = in_cluster(spark, 1, lambda: fr.lay_out(spark, parts))
    other = in_cluster(spark, 1, lambda: fr.split_offsets(spark, parts).table(), "700")
    first = layer.rows.filter("pos = 17").limit(1)
    moved = layer.rows.withColumn("pos", F.when((F.col("pos") == 399) & (F.col("_part") == 0), None).otherwise(F.col("pos")))
    for rows, offsets in ((layer.rows, other), (layer.rows.filter("pos <> 399"), layer.offsets), (layer.rows.unionByName(first), layer.offsets), (moved, layer.offsets)):
        with pytest.raises(RuntimeError, match="not all placed"):
            fr.check_positions(fr.Layer(parts, rows, offsets))


def test_values_are_not_shuffled(spark, tmp_path):
    edition(tmp_path / "e2014", 9000)
    rows, _ = fr.load_editions(spark, {2014: str(tmp_path / "e2014")}, (72, 79), with_id=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # Only counts per range are exchanged.
    assert "SelectedBucketsCount" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    whole, _ = fr.load_editions(spark, {2014: str(tmp_path / "e2014")}, None)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    ids = sorted((r.pos, r.id) for r in rows.collect())
    assert [i for _, i in ids] == list(range(len(ids))) and len(ids) > 1000


def test_headers_come_in_one_job(spark, tmp_path):
    edition(tmp_path / "e2014", 9000)
    names = ["CO_CURSO", "b ç", "", "B ç", "CO_CURSO"]
    write(tmp_path / "e2014" / "odd é.txt", names, [("x",) * 5])
    files = fr.discover(spark, str(tmp_path / "e2014"))
    context = spark.sparkContext
    context.setJobGroup("headers", "headers")
    try:
        found = fr.headers(spark, files)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("headers")) == 1
    assert all(found[f] == tuple(fr.read_text(spark, f).columns) for f in files) and len(files) == 5
    assert fr.headers(spark, []) == {}


def test_lines_of_other_lengths_are_counted_and_kept(spark, tmp_path):
    expected = edition(tmp_path / "e2014", 50)
    file = tmp_path / "e2014" / "b_scores.txt"
    lines = file.read_text("latin-1").splitlines()
    lines[4], lines[9] = lines[4] + ";mais;ainda", "só"
    file.write_bytes(("\n".join(lines) + "\n\n").encode("latin-1"))
    done = fr.load(spark, {2014: str(tmp_path / "e2014")}, None)
    assert {(r.pos, r.linha) for r in done.rejects.collect()} == {(3, lines[4]), (8, "só")}
    per = {r.fragmento.rsplit("/", 1)[1]: (r.situacao, r.linhas, r.linhas_malformadas) for r in done.fragments.collect()}
    assert per == {"a_ident.txt": ("ok", 50, 0), "b_scores.txt": ("ok", 50, 2), "c_income.txt": ("ok", 50, 0)}
    line = done.report.first()
    assert (line.linhas_malformadas, line.alinhado, line.fragmentos_com_erro) == (2, True, 0)
    rows = {r.pos: r for r in done.rows.collect()}
    assert (rows[8].NT_GER, rows[8].NO_IES) == (None, expected[8][3]) and rows[3].NT_GER == expected[3][4] and rows[9].NT_GER == expected[9][4]


def spoil(file, at):
    """Checksums that hold up to a byte of the file and not beyond."""
    import zlib

    raw, per = file.read_bytes(), 512
    sums = [zlib.crc32(raw[i : i + per]) for i in range(0, len(raw), per)]
    sums = [c if i * per < at else c ^ 1 for i, c in enumerate(sums)]
    head = b"crc\0" + per.to_bytes(4, "big")
    (file.parent / f".{file.name}.crc").write_bytes(head + b"".join(c.to_bytes(4, "big") for c in sums))


def test_a_body_that_cannot_be_read_drops_its_fragment(spark, tmp_path):
    expected = edition(tmp_path / "e2014", 30_000)
    spoil(tmp_path / "e2014" / "deep" / "c_income.txt", 140_000)
    folders = {2014: str(tmp_path / "e2014")}
    with pytest.raises(Exception, match="(?i)checksum|read"):
        fr.load(spark, folders, None)
    done = fr.load(spark, folders, None, on_error="skip")
    per = {r.fragmento.rsplit("/", 1)[1]: (r.situacao, r.linhas) for r in done.fragments.collect()}
    assert per["c_income.txt"] == ("erro", None) and per["a_ident.txt"] == per["z_other.txt"] == ("ok", 30_000)
    line = done.report.first()
    assert (line.situacao, line.fragmentos_com_erro, line.alinhado) == ("ok", 1, True)
    # The next fragment that offers the column supplies it.
    assert {r.QE_I05 for r in done.rows.select("QE_I05").distinct().collect()} == {"?"}
    assert done.rows.count() == len(expected)


def test_an_edition_whose_identification_cannot_be_read_is_reported(spark, tmp_path):
    edition(tmp_path / "e2014", 20)
    edition(tmp_path / "e2017", 30_000)
    spoil(tmp_path / "e2017" / "a_ident.txt", 400_000)
    done = fr.load(spark, {y: str(tmp_path / f"e{y}") for y in (2014, 2017)}, None, on_error="skip")
    report = {r.ano: (r.situacao, r.fragmentos_com_erro, r.maior_fragmento) for r in done.report.collect()}
    assert report == {2014: ("ok", 0, 20), 2017: ("ValueError", 1, None)}
    assert done.rows.count() == 20
