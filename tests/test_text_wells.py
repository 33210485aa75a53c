import pytest
from pyspark.sql import functions as F

from ensemble.operators import text, wells
from ensemble.sources import files


def test_tail_lines(spark):
    rows = [(n, "\n".join(f"l{i}" for i in range(n)) + "\n") for n in (10, 300, 301)] + [(0, "")]
    df = spark.createDataFrame(rows, "n int, t string")
    out = {r.n: r for r in df.select("n", text.line_count("t").alias("c"), text.tail_lines("t", 300).alias("tail")).collect()}
    assert out[10].c == 10 and out[10].tail.split("\n") == [f"l{i}" for i in range(10)]
    assert out[300].tail.split("\n")[0] == "l0"
    assert out[301].tail.split("\n")[0] == "l1" and len(out[301].tail.split("\n")) == 300
    assert out[0].tail == "" and out[0].c == 0


DECK = """-- comment
PVTO
0  \t 14.7\t 1\t 1.20 /
1.500\t 4000\t 1.1200\t 0.94
\t 5000\t 1.1189\t 0.94 /
/

EQUIL
   9035 3600 9950 0 8800 0 1 0 0 /
"""


def test_section_scan_keyword_text(spark):
    df = spark.createDataFrame([("deck", DECK)], "f string, t string")
    out = text.section_scan(text.text_lines(df, "f", "t"), rows_per_chunk=3).orderBy("lineno").collect()
    assert [r.section for r in out] == ["PVTO"] * 4 + ["EQUIL"]
    assert out[0].numbers == [0.0, 14.7, 1.0, 1.2] and out[0].terminated
    assert out[1].n_numbers == 4 and not out[1].terminated
    assert out[3].n_tokens == 0 and out[3].terminated
    assert out[4].n_numbers == 9


def test_well_key_filter_and_catalogue_union(spark):
    rows = [("r1", "WBHP:A", 1.0, "d", 1.0), ("r1", "WBHPH:A", 1.0, "d", 2.0), ("r1", "WOPR:A", 1.0, "d", 3.0),
            ("r2", "WBHP:A", 1.0, "d", 4.0), ("r2", "WBHP:B", 1.0, "d", 5.0)]
    v = spark.createDataFrame(rows, "run string, key_well string, days double, date string, value double")
    cat = {r.well: r.n_runs for r in wells.well_catalog(v).collect()}
    assert cat == {"A": 2, "B": 1}
    keys = {r.vector for r in wells.key_catalog(v).collect()}
    assert keys == {"WBHP", "WBHPH", "WOPR"}
    wide = wells.well_wide(v).where(F.col("run") == "r1").first()
    assert wide.WBHP == 1.0 and wide.WOPR == 3.0
    cmp = wells.run_comparison(v, ["r1", "r2"]).where("well = 'A' AND vector = 'WBHP'").first()
    assert cmp["r1"] == 1.0 and cmp["r2"] == 4.0
    assert wells.run_comparison(v).columns == ["well", "vector", "days", "r1", "r2"]
    with pytest.raises(ValueError, match="more than 1 runs"):
        wells.run_labels(v, most=1)


def test_failure_log_and_keyword_files(spark, tmp_path):
    from ensemble.sources import files
    out = spark.createDataFrame([("spe9", 1, False, "a\nb\n", None), ("spe9", 2, True, "x", "y")],
                                "reservoir_id string, sim_id long, ok boolean, stdout string, stderr string")
    logs = text.failure_logs(out, 1).collect()
    assert len(logs) == 1 and logs[0].log == "=== STDOUT (tail) ===\nb\n\n=== STDERR (tail) ===\n\n"
    p = tmp_path / "deck.inc"
    p.write_text(DECK)
    kf = files.read_keyword_files(spark, str(p))
    scanned = text.section_scan(text.text_lines(kf, "file", "text")).collect()
    assert {r.section for r in scanned} == {"PVTO", "EQUIL"} and len(scanned) == 5


def test_split_files_number_as_a_whole_read(spark, tmp_path):
    """One file over many splits gives the same lines and sections as reading it whole."""
    body = "\n".join(["first line", "EQUIL"] + [f"  {i} {i * 0.5} /" if i % 7 else f"KEY{i}" for i in range(400)] + ["-- end", "", "last"]) + "\n"
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text(body + name + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        raw = files.read_keyword_lines(spark, str(tmp_path))
        assert raw.select("file", "block").distinct().count() > 10
        got = text.scan_keyword_files(raw).collect()
        numbered = text.numbered_lines(raw).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name in ("a", "b"):
        want, section, no, lines = [], None, 0, (body + name).split("\n")
        for i, x in enumerate(lines):
            t = x.strip()
            if t and t.isalnum() and t.upper() == t and t[0].isalpha():
                section, no = t, no + 1
            elif t and not t.startswith("--"):
                want.append((i, section, x))
        mine = [r for r in got if r.file.endswith(f"/{name}.txt")]
        assert sorted((r.lineno, r.section, r.line) for r in mine) == want
        assert sorted((r.lineno, r.line) for r in numbered if r.file.endswith(f"/{name}.txt")) == list(enumerate(lines))
        assert max(r.section_no for r in numbered if r.file.endswith(f"/{name}.txt")) == no


def test_sections_carried_over_chunks_of_a_table(spark):
    rows = [(f, i, f"KEY{i}" if i % 50 == 0 and i else f"word {i}") for f in ("x", None) for i in range(300)]
    df = spark.createDataFrame(rows, "file string, lineno long, line string")
    got = text.section_scan(df, rows_per_chunk=20).collect()
    assert {(r.file, r.lineno): r.section for r in got} == {
        (f, i): f"KEY{i // 50 * 50}" if i >= 50 else None for f, i, _ in rows if i % 50 or not i}
