"""Sources, identity, store, verbs and streams."""

import json
from datetime import date, datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import curation, graph, identity, reports, retrieval, scoring
from vellum.plans import api, search, store
from vellum.schema import CHUNK, NOTE
from vellum.sources import code, feeds, lines, notes

NOW = datetime(2024, 2, 1, 12, 0, tzinfo=timezone.utc)
FILE = "---\nid: tech-cookie\ntype: Technique\ntitle: Cookie sandwich\ntags: xss\ncwe: 79\nbounty: lots\ncreated: 2024-05-01T10:00\nextra: {status: x}\naliases: [a]\n---\n\nbody with [[other]]\n"


@pytest.fixture
def vault(tmp_path):
    for name, body in {"technique/Cookie sandwich.md": FILE, "finding/other.md": FILE.replace("tech-cookie", "find-other").replace("Cookie sandwich", "Other"), "finding/bad.md": "# just text\nhello", ".trash/x.md": FILE, "_drafts/y.md": FILE, "README.md": FILE, "Templates/t.md": FILE}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body, encoding="utf-8")
    return str(tmp_path)


def test_notes_are_read_with_their_faults(spark, vault):
    got = {r["path"]: r for r in notes.read_notes(spark, vault).collect()}
    assert set(got) == {"technique/Cookie sandwich.md", "finding/other.md", "finding/bad.md"}
    n = got["technique/Cookie sandwich.md"]
    assert (n["type"], n["tags"], n["cwe"], n["created"], n["bounty"]) == ("technique", ["xss"], ["CWE-79"], date(2024, 5, 1), None)
    assert n["invalid"] == {"bounty": "lots"} and json.loads(n["unmodelled"]) == {"aliases": ["a"]}
    assert got["finding/bad.md"]["error"] == "no frontmatter"


def test_a_rendered_note_reads_the_same():
    first = notes.parse_note(FILE)
    again = notes.parse_note(notes.render_note(first))
    assert first == again
    assert notes.parse_note("﻿" + FILE)["id"] == "tech-cookie"
    assert notes.parse_note("")["error"] == "empty file"


def test_adopted_files_have_their_own_ids(spark):
    files = spark.createDataFrame([("finding/idea.md", "# Title\nx"), ("technique/idea.md", "x")], "path string, text string")
    got = {r["path"]: r for r in notes.adopt(files).collect()}
    assert got["finding/idea.md"]["id"] == "local-idea" and got["finding/idea.md"]["title"] == "Title"
    assert got["technique/idea.md"]["id"].startswith("local-idea-") and got["technique/idea.md"]["type"] == "technique"


def test_tombstones_know_their_source(spark):
    rows = spark.createDataFrame([("a", None, "nvd"), ("b", None, "nvd"), ("c", None, None), ("d", "https://www.s.org/x/?utm_source=1", "rss"), ("e", "https://s.org/y", "rss")], "id string, url string, source string")
    stones = spark.createDataFrame([("a", None, "NVD"), ("b", None, "other"), ("c", None, "other"), (None, "http://s.org/x", None)], "id string, url string, source string")
    assert {r["id"] for r in identity.not_tombstoned(rows, stones).collect()} == {"b", "e"}
    assert identity.add_tombstones(stones, stones).count() == 0
    assert identity.remove_tombstones(stones, stones.where("id = 'a'")).count() == 3


def test_epss_writes_only_what_changes(spark):
    n = spark.createDataFrame([("CVE-1", 0.5, 0.9, ["high-epss"]), ("CVE-2", 0.9, 0.99, ["high-epss"]), ("CVE-3", None, None, [])], "id string, epss double, epss_percentile double, tags array<string>")
    s = spark.createDataFrame([("CVE-1", 0.5, 0.9), ("CVE-2", 0.1, 0.2), ("CVE-3", 0.7, 0.8)], "cve string, epss double, percentile double")
    got = {r["id"]: r["tags"] for r in identity.apply_epss(n, s).collect()}
    assert got == {"CVE-2": [], "CVE-3": ["high-epss"]}


def test_carrier_prefers_the_same_document(spark):
    files = spark.createDataFrame([("i", "a.md", "Other", "https://x.org/2", "rss", 9.0), ("i", "b.md", "T", "https://x.org/1", "rss", 1.0)], "id string, path string, title string, url string, source string, mtime double")
    wanted = spark.createDataFrame([("i", "T", "http://x.org/1", "rss", "T.md")], "id string, title string, url string, source string, title_path string")
    assert identity.carrier(files, wanted).first().asDict() == {"id": "i", "path": "b.md", "conflict": None}


def test_own_reports_follow_their_state(spark):
    schema = "id string, source string, state string, tags array<string>, cwe array<string>, body string"
    s = spark.createDataFrame([("r", "hackerone-mine", "triaged", ["mine", "triaged", "keepme"], [], "mine own words")], schema)
    i = spark.createDataFrame([("r", "hackerone-mine", "duplicate", ["mine", "duplicate", "dupe"], ["CWE-1"], "feed")], schema)
    r = identity.merge_own_reports(s, i).first()
    assert r["tags"] == ["mine", "keepme", "duplicate", "dupe"] and r["body"] == "mine own words" and r["status"] == "merged"


def test_snapshots(spark, tmp_path):
    s = store.Snapshots(spark, f"file://{tmp_path}/t", "id string, note_id string, path string, quality int")
    make = lambda rows: spark.createDataFrame(rows, s.schema)
    assert s.read().count() == 0
    s.overwrite(make([("1", "a", "p", 5), ("2", "a", "q", 6), ("3", "b", "q", 7)]), {"chunker": "c1", "model": "m", "dim": 4})
    s.append(make([("4", "c", "r", 8)]))
    before = s.read()
    s.replace_scope(make([("9", "a", "p", 1)]), make([("", "", "p", 0)]), "path")
    assert {r["id"] for r in s.read().collect()} == {"9", "2", "3", "4"}
    assert {r["id"] for r in before.collect()} == {"1", "2", "3", "4"}  # an open reader keeps its snapshot
    version = s.pointer()["version"]
    assert s.delete(make([("", "zz", "", 0)]), "note_id") == 0 and s.pointer()["version"] == version
    assert s.rescore(spark.createDataFrame([("b", 400), ("c", 8)], "note_id string, quality int")) == 1
    assert s.read().where("note_id = 'b'").first()["quality"] == 100
    assert s.stale_reason(chunker="c1", model="m", dim=4) is None and "dim" in s.stale_reason(chunker="c1", model="m", dim=5)
    with pytest.raises(store.DimMismatch):
        s.check_dim(5)
    s.append(make([("5", "d", "r", 8)]))
    assert s.optimize(force=True)["compacted"] and s.read().count() == 5
    s.drop()
    assert s.read().count() == 0


def test_mass_delete_guard():
    assert reports.reap_allowed(50, 10) and not reports.reap_allowed(51, 10) and reports.reap_allowed(200, 1000)


def _notes(spark, rows):
    names = [c.split(" ")[0] for c in NOTE.split(", ")]
    base = {n: None for n in names} | {"tags": [], "cwe": [], "links": [], "assets": [], "invalid": {}, "extra": "{}", "mtime": 1.0}
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], NOTE)


def _vault(spark):
    return _notes(
        spark,
        [
            {"id": "tech-a", "path": "technique/Alpha.md", "type": "technique", "title": "Alpha", "body": "cookie sandwich parsing quirk\n\n## Steps\n1. go\n\n## Impact\nbad", "links": ["beta"], "source": "manual"},
            {"id": "tech-b", "path": "technique/Beta.md", "type": "technique", "title": "Beta", "body": "request smuggling over pipelines [[Gamma]]", "source": "manual", "program": "Acme"},
            {"id": "find-c", "path": "finding/Gamma.md", "type": "finding", "title": "Gamma", "body": "template injection", "source": "nvd", "url": "https://s.org/g"},
        ],
    )


def test_search_ranks_and_filters(spark):
    chunks = search.index_rows(_vault(spark)).persist()
    assert [c.split(" ")[0] for c in CHUNK.split(", ")] == chunks.columns
    hits = search.search(spark, chunks, ["cookie sandwich", "Cookie Sandwich", "parsing quirk"], now=0.0, k=2).collect()
    assert hits[0]["note_id"] == "tech-a" and hits[0]["matched_queries"] == [0, 1]
    only = search.search(spark, chunks, "cookie", now=0.0, filters={"program": "acme"}).collect()
    assert {h["note_id"] for h in only} == {"tech-b"}
    with pytest.raises(ValueError):
        search.search(spark, chunks, "x", now=0.0, filters={"cwe": "CWE-"})
    reranked = search.search(spark, chunks, "cookie", now=0.0, k=1, scorer=lambda t: F.when(t.contains("injection"), 9.0).otherwise(-9.0)).collect()
    assert reranked[0]["note_id"] == "find-c"


def test_links_expand_and_references_resolve(spark):
    n = _vault(spark)
    seeds = n.where("id = 'tech-a'").select("path")
    near = graph.expand(seeds, graph.edges(n), graph.keys(n), hops=2).collect()
    assert [(r["path"], r["hop"]) for r in near] == [("technique/Beta.md", 1), ("finding/Gamma.md", 2)]
    assert api.get_note(n, "tech-a", "impact")["body"] == "## Impact\nbad"
    assert api.get_note(n, "gamma")["id"] == "find-c"
    with pytest.raises(api.VerbError):
        api.get_note(n, "nothing")


def test_verbs(spark):
    n = _vault(spark)
    new = api.remember(n, "A finding", "text", now=NOW, tags=["x"])
    assert new.first()["id"] == "find-a-finding-20240201120000000"
    more = api.remember(n.unionByName(new), "a FINDING", "again", now=NOW).first()
    assert more["id"] == new.first()["id"] and more["body"].endswith("## Update 2024-02-01 12:00 UTC\n\nagain\n")
    idea = api.capture_idea(n, "Try it", "because", now=NOW, tags=["z"])
    done = api.resolve_idea(idea, idea.first()["id"], "failed", "no luck").first()
    assert done["tags"] == ["idea", "status/failed", "z"] and done["body"].startswith("**Status:** failed") and done["body"].endswith("**Outcome (failed):** no luck")
    with pytest.raises(api.VerbError):
        api.update_note(n, "find-c", title="T")
    assert api.update_note(n, "find-c", force=True, title="T", tags_add=["a", "b"], tags_remove=["B"]).first()["tags"] == ["a"]
    left, trash, chunks, stones = api.forget_note(n, search.index_rows(n), "tech-b", "old", "t")
    assert left.count() == 2 and trash.first()["deleted_reason"] == "old" and chunks.where("note_id = 'tech-b'").isEmpty() and stones.count() == 1
    assert api.restore_note(left, trash, "tech-b").count() == 3
    none = spark.createDataFrame([], "id string, url string, source string")
    assert api.capture_url(n, none, "http://www.s.org/g/?utm_source=x", "G", "")[0] == "stored"
    assert api.capture_url(n, none, "http://127.0.0.1/", "G", "")[0] == "blocked"
    assert api.capture_url(n, none, "http://s.org/new", "New one", "<p>hi</p>")[1].first()["body"] == "hi"


def test_pruning_is_fail_closed(spark):
    n = _notes(spark, [{"id": "x", "path": "1", "type": "report", "source": "nvd", "created": date(2019, 1, 1), "body": "b"}, {"id": "idea-y", "path": "2", "type": "report", "source": "nvd", "created": date(2019, 1, 1)}, {"id": "z", "path": "3", "type": None, "source": None}, {"id": "w", "path": "4", "type": "report", "source": "nvd"}])
    plan = scoring.prune_plan(n)
    assert {r["id"] for r in plan.where("NOT keep").collect()} == {"x"}
    kept, gone = scoring.apply_prune(n, plan.withColumn("keep", F.lit(False)))
    assert {r["id"] for r in gone.collect()} == {"x"} and kept.count() == 3


def test_feeds(spark, tmp_path):
    (tmp_path / "kev.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1", "vendorProject": "Acme", "product": "Box", "vulnerabilityName": "Hole", "dateAdded": "2024-01-02", "shortDescription": "s", "requiredAction": "patch", "cwes": ["cwe-79"]}]}))
    k = feeds.kev(feeds.read_json(spark, f"{tmp_path}/kev.json", feeds.KEV)).first()
    assert k["title"] == "CVE-1 — Hole" and k["tags"] == ["kev", "known-exploited", "acme", "box"] and k["cwe"] == ["CWE-79"] and "## Ransomware use\nUnknown" in k["body"]
    item = lambda i, d, m: {"cve": {"id": i, "published": "2024-01-01T00", "descriptions": [{"lang": "en", "value": d}], "weaknesses": [{"description": [{"value": "CWE-79"}]}], "metrics": m, "references": [{"url": f"u{j}"} for j in range(12)]}}
    v2 = {"cvssMetricV2": [{"baseSeverity": "HIGH", "cvssData": {"baseScore": 7.5, "vectorString": "V"}}]}
    (tmp_path / "nvd.json").write_text(json.dumps({"vulnerabilities": [item("CVE-2", "d" * 100, v2), item("CVE-2", "d" * 100, v2), item("CVE-3", "** REJECT ** no", {})]}))
    (n,) = feeds.nvd(feeds.read_json(spark, f"{tmp_path}/nvd.json", feeds.NVD)).collect()
    assert (n["id"], n["severity"], n["cwe"]) == ("CVE-2", "high", ["CWE-79"]) and n["title"].endswith("…") and n["body"].count("\n- ") + 0 == 10
    (tmp_path / "w.json").write_text(json.dumps({"data": [{"Links": [{"Title": "A title", "Link": "https://www.b.org/x"}], "Bugs": ["XSS"], "Programs": ["P"], "Bounty": "$1,500", "PublicationDate": "2023-01-02"}, {"Links": []}]}))
    (w,) = feeds.writeups(feeds.read_json(spark, f"{tmp_path}/w.json", feeds.WRITEUPS)).collect()
    assert (w["id"], w["source"], w["bounty"], w["tags"]) == ("writeup-a-title", "b.org", 1500.0, ["b.org", "pentesterland", "writeup"])
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Post</title><link>https://b.org/p?x=1</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;hello&lt;/p&gt;</description></item><item><title>Again</title><link>https://b.org/p</link></item></channel></rss>")
    assert feeds.rss(spark, f"{tmp_path}/f.xml").count() == 1
    assert feeds.batches(spark.range(250).selectExpr("cast(id as string) AS id"), 100).agg(F.sum(F.size("ids"))).first()[0] == 250


def test_public_reports(spark):
    schema = "id long, title string, vulnerability_information string, weakness struct<name:string>, structured_scope struct<asset_identifier:string,max_severity:string>, team struct<handle:string,profile:struct<name:string>>, disclosed_at string, created_at string, `has_bounty?` boolean, vote_count long, original_report_id long"
    rows = [(1, "T", "x" * 50, ("Reflected XSS",), ("a", "none"), ("h", ("Prog",)), "2024-01-02T", None, True, 3, None), (2, "T", "short", None, None, None, None, None, None, None, None)]
    (r,) = feeds.public_reports(spark.createDataFrame(rows, schema)).collect()
    assert (r["id"], r["cwe"], r["severity"], r["program"], r["tags"]) == ("h1-1", ["CWE-79"], None, "Prog", ["hackerone", "disclosed", "reflected xss"])


def test_release_rows_and_totals(spark):
    from vellum.queries.texts import _POSTS

    posts = spark.createDataFrame(_POSTS, "url string, title string, published string, text string").withColumn("published", F.to_date("published"))
    rows = code.release_rows(posts)
    got = {r["cve"]: r for r in rows.collect()}
    assert (got["CVE-2024-1001"]["component"], got["CVE-2024-1001"]["reporter"], got["CVE-2024-1001"]["reward_usd"], got["CVE-2024-1001"]["reported_on"]) == ("Dawn", "M. Smith", 3000.0, "2024-03-02")
    assert (got["CVE-2024-1002"]["reporter"], got["CVE-2024-1002"]["internal"], got["CVE-2024-1002"]["reward_usd"], got["CVE-2024-1002"]["reported_on"]) == ("Google", True, None, "2024-03-05")
    assert got["CVE-2024-1003"]["reporter"] == "A. B. Lee" and got["CVE-2024-1003"]["reward"] == "N/A"
    totals = {r["url"]: r for r in code.release_totals(rows, posts).collect()}
    assert totals["https://r.example/1"]["mismatch"] and not totals["https://r.example/2"]["mismatch"] and totals["https://r.example/2"]["channel"] == "Extended Stable"


def test_logs(spark, tmp_path):
    (tmp_path / "log").write_text("\x01" + "\x1f".join(["a" * 40, "2024-01-02", "Ann", "Fix use-after-free in frame", "Why.\n\nBug: 12345678, 12345678\nChange-Id: I1"]) + "\x02\ncontent/browser/x.cc\nmojo/y.h\n\x01" + "\x1f".join(["b" * 40, "2024-01-03", "Bob", "Roll security deps", ""]) + "\x02\n")
    (f,) = code.fix_notes(code.commits(spark, f"{tmp_path}/log")).collect()
    assert f["classes"] == ["memory-safety"] and f["bug_ids"] == ["12345678"] and f["body"] == "Why." and f["tags"][-2:] == ["content-browser", "mojo"]
    (tmp_path / "st").write_text("\x01c1\x1f2024-01-05\x1fAdd\nA\tdocs/security/a.md\n\n\x01c2\x1f2024-01-01\x1fMove\nR100\told.md\tdocs/security/a.md\n")
    changes = code.doc_changes(spark, f"{tmp_path}/st")
    docs = spark.createDataFrame([("docs/security/a.md", "# [Rules](x) {#r}\n\n## One {#o}\ntext\n### Two\n")], "path string, text string")
    (d,) = code.doc_notes(docs, changes).collect()
    assert d["title"] == "Chromium: Rules (docs/security/a.md)" and d["tags"] == ["chromium", "google", "vendor-doc", "security-doc", "new-doc"] and d["commits"] == 2 and d["sections"] == 2


def test_line_files_keep_their_faults(spark, tmp_path):
    (tmp_path / "v.jsonl").write_bytes('﻿{"url": "u1", "decision": "keep"}\n\nnot json\n[1]\n{"url": "u2"}\n'.encode())
    got = {r["line"]: (r["url"], r["problem"]) for r in lines.read_lines(spark, f"{tmp_path}/v.jsonl", "url string, decision string").collect()}
    assert got == {1: ("u1", None), 3: (None, "not a JSON object"), 4: (None, "not a JSON object"), 5: ("u2", None)}


def test_verdicts_apply_in_order(spark):
    row = lambda i, u, d, t="T", reason=None: (i, u, d, "k", reason or ("post-cutoff" if d == "keep" else "already-known"), "j", t, "w", "b")
    v = spark.createDataFrame([row(1, "https://a.org/1/", "keep"), row(2, "https://a.org/2", "keep"), row(3, "https://a.org/1", "keep"), row(4, "https://a.org/3", "drop"), row(5, "https://a.org/3?x", "drop"), row(6, "https://a.org/9", "drop"), row(7, "https://a.org/4", "keep", reason="nice"), row(8, "https://a.org/2", "keep", "Other")], "line int, url string, decision string, already_known string, reason string, justification string, technique_title string, when_to_try string, body_md string")
    c = spark.createDataFrame([(f"https://A.org/{i}?source=rss",) for i in range(1, 5)], "url string")
    empty = spark.createDataFrame([], "url string"), spark.createDataFrame([], "id string, url string")
    got = {r["line"]: (r["action"], r["note_id"]) for r in curation.apply_verdicts(v, c, *empty).collect()}
    assert got[1] == got[3] == ("keep", "tech-t") and got[2][0] == "keep" and got[2][1].startswith("tech-t-")
    assert [got[i][0] for i in (4, 5, 6, 7, 8)] == ["drop", "duplicate", "skip", "skip", "skip"]


def test_widening_happens_once():
    assert retrieval.widened_pool(8, 40, 3, 40) == 120
    assert retrieval.widened_pool(8, 40, 8, 40) == retrieval.widened_pool(8, 40, 3, 39) == 40
    assert retrieval.widened_pool(8, 300, 3, 300) == 400 and retrieval.widened_pool(8, 400, 3, 400) == 400


def test_late_events_are_left_out_and_state_is_kept(spark, tmp_path):
    from vellum.streaming import flows

    src, top = tmp_path / "in", str(tmp_path)
    schema = "ts timestamp, event_type string, value double, user_id long"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{name}")
    at = lambda h: datetime(2024, 1, 1, h)
    df = lambda: flows.tumbling(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src)), "1 hour", "1 hour")
    put("a", [(at(1), "x", 1.0, 1), (at(9), "x", 1.0, 1)])
    flows.run_to_table(df(), f"{top}/out", f"{top}/cp").awaitTermination()
    put("b", [(at(1), "x", 5.0, 1), (at(12), "x", 1.0, 1)])
    flows.run_to_table(df(), f"{top}/out", f"{top}/cp").awaitTermination()
    got = {r["start_ts"].hour: r["total"] for r in spark.read.parquet(f"{top}/out").collect()}
    assert got == {1: 1.0, 9: 1.0}


def test_merging_bodies():
    from vellum.functions.bodies import merge_body

    stored = "mine\n\n## Summary\nold\n\n## Notes\nmine too\n\n```\n## Summary\nnot a heading\n```"
    got = merge_body(stored, "**A B** — hole\n\n## Summary:\nnew\n\n## CVSS\n9", leads=True)
    assert got.startswith("**A B** — hole\n\nmine\n\n## Summary:\nnew\n\n## Notes\nmine too") and got.endswith("## CVSS\n9") and "not a heading" in got
    assert merge_body(got, "**A B** — hole\n\n## Summary:\nnew\n\n## CVSS\n9", leads=True) == got


def test_nominations_and_articles(spark):
    from vellum.sources import pages

    lists = spark.createDataFrame([(2023, '<a href="https://blog.b.org/p">x</a><a href="https://blog.b.org/p">A <b>longer</b> title</a><a href="https://x.com/u">y</a>')], "year int, html string")
    found = pages.nominations(lists)
    assert [(r["url"], r["anchor"]) for r in found.collect()] == [("https://blog.b.org/p", "A longer title")]
    page = "<title>The page's own title</title><time datetime='2023-05-06'><p>" + "good words here " * 60
    (n,) = pages.articles(found, spark.createDataFrame([("https://blog.b.org/p", page)], "url string, html string")).collect()
    assert (n["title"], str(n["created"]), n["reason"]) == ("The page's own title", "2023-05-06", None) and n["tags"] == ["blog.b.org", "top10", "top10-2023", "writeup"]


def test_technique_notes(spark):
    kept = spark.createDataFrame([("https://a.org/1", "tech-t", "T", "post-cutoff", "when", "no", "body", ["x", " "])], "key string, note_id string, technique_title string, reason string, when_to_try string, already_known string, body_md string, tags array<string>")
    c = spark.createDataFrame([("rss", "https://A.org/1/", date(2024, 1, 1), "slug", "T", "text")], "source string, url string, created date, slug string, title string, body string")
    (n,) = curation.technique_notes(kept, c).collect()
    assert n["tags"] == ["post-cutoff", "technique", "x"] and n["body"] == "**When to try:** when\n\nbody\n\n---\nSource: https://A.org/1/" and n["links"] == ["slug"]
    assert c.select(curation.gate_prompt()).first()[0].startswith("Title: T\nSource: rss\nPublished: 2024-01-01\nURL: https://A.org/1/\n\n--- content ---\ntext")


def test_knn_takes_any_number_of_queries(spark):
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, (900, 4)).astype(float)  # many ties
    v = spark.createDataFrame([(i, x.tolist(), f"n{i}") for i, x in enumerate(data)] + [(900, None, "none")], "id long, vector array<float>, note string").repartition(3)
    asked = v.where("id % 5 = 0").select(F.col("id").alias("qi"), F.col("vector").alias("qv"))
    got = {(r["qi"], r["rank"]): (r["id"], r["note"], r["dist"]) for r in retrieval.knn(v, asked, 7).collect()}
    want = {}
    for q in range(0, 900, 5):
        dist = ((data - data[q]) ** 2).sum(axis=1)
        want |= {(q, n + 1): (int(i), f"n{i}", dist[i]) for n, i in enumerate(np.argsort(dist, kind="stable")[:7])}
    assert got == want


def test_bm25_joins_large_query_sets_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common word{i % 7} word{i % 11} tail{i}") for i in range(80)], "id long, search_text string")
    asked = docs.where("id % 5 = 0").select(F.col("id").alias("qi"), F.col("search_text").alias("query"))
    few = sorted(map(tuple, retrieval.bm25(docs, asked, 3).collect()))
    monkeypatch.setattr(retrieval, "FEW_TERMS", 3)
    assert sorted(map(tuple, retrieval.bm25(docs, asked, 3).collect())) == few and len(few) == 48
    assert all(i == qi for i, qi, _, rank in few if rank == 1)


def _table(spark, tmp_path):
    make = lambda *ids: spark.createDataFrame([(i, "n", "p", 1) for i in ids], "id string, note_id string, path string, quality int")
    return store.Snapshots(spark, f"file://{tmp_path}/t", "id string, note_id string, path string, quality int"), make, lambda s: sorted(r["id"] for r in s.read().collect())


def test_of_two_writers_from_one_version_none_is_lost(spark, tmp_path):
    s, make, ids = _table(spark, tmp_path)
    s.overwrite(make("a"))
    was = s.pointer()
    s.append(make("b"))
    with pytest.raises(store.Conflict):
        s._commit(was, ["part-of-a-slow-writer"])
    assert ids(s) == ["a", "b"]
    # a writer that was overtaken while it worked starts again from what the other left
    other, turns = store.Snapshots(spark, s.root, s.schema), []
    write = s._write

    def slow(rows):
        name = write(rows)
        if not turns:
            turns.append(1)
            other.append(make("c"))
        return name

    s._write = slow
    assert s.delete(make("a"), "id") == 1 and ids(s) == ["b", "c"]
    s.append(make("d"))
    assert ids(s) == ["b", "c", "d"]


@pytest.mark.parametrize("dies_at", ["create temp", "create claim", "rename"])
def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, dies_at, monkeypatch):
    s, make, ids = _table(spark, tmp_path)
    s.overwrite(make("a"))

    class Dead(BaseException):
        pass

    create, steps = s._create, []

    def dying(path, text):
        steps.append(path.getName())
        if dies_at == "create temp" and steps[-1].startswith(".v") or dies_at == "create claim" and steps[-1].startswith("_v"):
            raise Dead
        create(path, text)
        if dies_at == "rename" and steps[-1].startswith("_v"):
            raise Dead

    s._create = dying
    with pytest.raises(Dead):
        s.append(make("b"))
    left = store.Snapshots(spark, s.root, s.schema)
    assert ids(left) == ["a"]
    monkeypatch.setattr(store.Snapshots, "CLAIM_S", -1)  # the dead writer's claim is old by now
    left.append(make("c"))
    assert ids(left) == ["a", "c"]
    left.drop()
    assert left.pointer() is None and ids(left) == []
