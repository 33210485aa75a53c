import hashlib

from ensemble.llm import warc
from ensemble.llm.queries import WARC_SQL, op9_warc_fixity
from conftest import SF_SMALL
from oracle_compare import compare, duck

SCHEMA = "page_id long, url string, html string, archive string, node int, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "a", 1, "d") for i, u, h in rows], SCHEMA)


ROWS = [(i, f"http://x/{i}", "<p>é" + "y" * (i % 50) + "\r\n\r\n</p>") for i in range(3000)] + \
    [(5, "http://x/5", "again"), (5, "http://x/5", "again"), (None, None, None), (4000, None, "h"), (4001, "u", "z" * 300_000)]


def test_damage_is_located(spark):
    base = pages(spark, ROWS)
    changed, lost = {17, 18, 2000}, 4001
    copy = [(i, u, (h or "") + "!" if i in changed else h) for i, u, h in ROWS if i != lost] + [(2900, "new", "new")]
    got = warc.fixity(base, warc.records(pages(spark, copy))).collect()
    status = {}
    for r in got:
        status.setdefault(r.status, set()).add(r.page_id)
    # records behind a changed length or a new record move, so their offset ranges differ too
    assert changed <= status["changed"] and lost in status["missing"] and len(status["extra"]) == 1
    moved = {i for i in range(3000) if i // 1024 == 0 and i > 18} | {i for i in range(2001, 3000) if i // 1024 == 1}
    assert {2, 16, 1030, 1999, 4000, None} <= status["intact"] and not (status["changed"] & {2, 16, 1030, 1999}) and 900 in moved & status["changed"]
    same = warc.fixity(base, warc.records(base)).collect()
    assert len(same) == len(ROWS) and {r.status for r in same} == {"intact"}


def test_equal_lengths_change_only_their_record(spark):
    base = pages(spark, ROWS[:3000])
    copy = [(i, u, h.replace("<p>", "<q>") if i in (3, 1500) else h) for i, u, h in ROWS[:3000]]
    got = warc.fixity(base, warc.records(pages(spark, copy))).filter("status <> 'intact'").collect()
    assert sorted((r.page_id, r.status) for r in got) == [(3, "changed"), (1500, "changed")]


def test_tree_equals_plain_hashing(spark):
    leaf = warc.leaves(warc.records(pages(spark, ROWS[:700]))).orderBy("archive", "leaf").collect()
    node = [(r.start, r.end, r.digest) for r in leaf]
    text = [warc_text(*r) for r in ROWS[:700]]
    assert [r.end - r.start for r in leaf] == [len(t.encode()) for t in text]
    while len(node) > 1:
        node = [(g[0][0], g[-1][1], hashlib.sha256(f"node:{g[0][0]}:{g[-1][1]}:{''.join(x[2] for x in g)}".encode()).hexdigest())
                for g in (node[i : i + warc.FAN] for i in range(0, len(node), warc.FAN))]
    top = warc.tree(spark.createDataFrame(leaf))[-1].collect()
    assert [(r.start, r.end, r.digest) for r in top] == node


def warc_text(page_id, url, html):
    return (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nWARC-Target-URI: {url}\r\n"
            f"Content-Type: text/html\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}\r\n\r\n")


def test_archives_hold_the_records(spark, tmp_path):
    rows = [r for r in ROWS[:1100]]
    warc.write_archives(pages(spark, rows), str(tmp_path / "out"))
    files = sorted((tmp_path / "out" / "archive=0").glob("part-*"))
    assert b"".join(f.read_bytes() for f in files) == "".join(warc_text(*r) for r in rows[:1024]).encode()


def test_empty_tables_and_sql(spark):
    none = pages(spark, [])
    assert warc.fixity(none, warc.records(none)).collect() == []
    few = pages(spark, ROWS[:3])
    assert {r.status for r in warc.fixity(few, warc.records(none)).collect()} == {"missing"}
    assert {r.status for r in warc.fixity(none, warc.records(few)).collect()} == {"extra"}
    ok, msg = compare(op9_warc_fixity(spark, SF_SMALL), duck(SF_SMALL), WARC_SQL)
    assert ok, msg
