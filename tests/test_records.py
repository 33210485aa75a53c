"""Records of keyword files: spanning lines, repeats, defaults, quotes, comments."""
import pytest
from pyspark.sql import functions as F

from ensemble.operators import records, scenarios as rules
from ensemble.sources import decks, files
from ensemble.sources.dimensions import control_table
from test_scenarios import SPE9, scen

DECK = """-- a comment, with a / in it
WCONPROD
  'PROD U/1*' 'OPEN'   -- the rest below
     'ORAT' 1500 3* -2.5 / and a remark
  'P2' 2* 7 /
/
EQUIL
1 2*3.5
4* 9
/
PORO
2*0.25 0.3
3*0.1 /
"""


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_items_over_lines_and_splits(spark, tmp_path, tiny_splits):
    (tmp_path / "deck.txt").write_text(DECK)
    items = records.record_items(files.read_keyword_lines(spark, str(tmp_path)))
    got = {}
    for r in records.expanded_items(items).collect():
        got.setdefault((r.section, r.record), {})[r.item] = r.value
    want = {("WCONPROD", 0): ["PROD U/1*", "OPEN", "ORAT", "1500", None, None, None, "-2.5"],
            ("WCONPROD", 1): ["P2", None, None, "7"],
            ("EQUIL", 3): ["1", "3.5", "3.5", None, None, None, None, "9"],
            ("PORO", 4): ["0.25", "0.25", "0.3", "0.1", "0.1", "0.1"]}
    assert got == {k: dict(enumerate(v)) for k, v in want.items()}
    assert items.where("section = 'PORO'").count() == 3  # repeats stay one row
    typed = records.typed_records(items, "WCONPROD").orderBy("record_no").collect()
    assert [(r.record_no, r.well_pattern, r.status, r.mode, r.rate) for r in typed] == [
        (1, "PROD U/1*", "OPEN", "ORAT", 1500.0), (2, "P2", None, None, 7.0)]
    eq = records.typed_records(items, "EQUIL").first()
    assert (eq.datum, eq.pressure, eq.woc, eq.pcow, eq.rvvd, eq.acc) == (1.0, 3.5, 3.5, None, 9, None)


def test_control_tables_equal_the_fixed_ones(spark, tmp_path, tiny_splits):
    path = str(tmp_path / "decks")
    decks.write_control_files(spark, path)
    tables = records.control_tables(files.read_keyword_lines(spark, path))
    for name, got in tables.items():
        want = control_table(spark, name)
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str), name


def test_hit_checks_on_parsed_tables(spark, tmp_path):
    path = tmp_path / "decks" / "deck=spe9"
    path.mkdir(parents=True)
    lines = decks.control_lines("spe9")
    at = next(i for i, x in enumerate(lines) if "INJE1" in x)
    (path / "a.txt").write_text("\n".join(lines) + "\n")
    s = scen(spark, [("spe9", 1, SPE9)])
    ctl = records.control_tables(files.read_keyword_lines(spark, str(path)))
    assert rules.apply_injector_rate(s, ctl["injector"]).first().rate == 4321.46
    lines[at] = lines[at].replace("RATE", "BHP")  # the rule misses its record
    (path / "a.txt").write_text("\n".join(lines) + "\n")
    spark.catalog.refreshByPath(str(path))
    ctl = records.control_tables(files.read_keyword_lines(spark, str(path)))
    with pytest.raises(Exception, match="0 records matched"):
        rules.apply_injector_rate(s, ctl["injector"]).count()
