"""Every command over its built-in example or files, by what it prints."""

import json

import pytest

from weftline import cli
from weftline.sources import feed_source
from weftline.sources.feeds import CATALOG


@pytest.fixture
def run(spark, capsys):
    def of(*args):
        assert cli.main(list(args)) == 0
        return capsys.readouterr().out.strip().split("\n")

    return of


def rows(lines):
    return [json.loads(x) for x in lines if x.startswith("{")]


def test_extract_correlate_and_graph(run, tmp_path):
    found = {(m["type"], m["canonical"], m["source_ref"]) for m in rows(run("extract"))}
    assert {("vessel", "Grey Heron", "R-1"), ("crypto-address", "addr-9f3kd2", "R-3"), ("ipv4", "198.51.100.7", "R-1"), ("org", "Lantern Shipping", "R-2"), ("geo", "36.1234, -5.4321", "R-3")} <= found
    reports, names = tmp_path / "r.json", tmp_path / "g.json"
    reports.write_text(json.dumps([{"id": "x", "text": "Gull met addr-1 and addr-2"}, {"id": "y", "text": "addr-1, addr-2"}]))
    names.write_text(json.dumps({"vessel": {"Gull": []}}))
    near = rows(run("correlate", "--reports", str(reports), "--gazetteer", str(names), "--value", "ADDR-1"))
    assert [(n["value"], n["weight"], sorted(n["shared"])) for n in near] == [("addr-2", 2.0, ["x", "y"]), ("Gull", 1.0, ["x"])]
    parts = run("graph", "--reports", str(reports))
    assert any('addr-2' in x for x in parts)
    kinds = [o["type"] for o in rows(run("graph", "--stix", "--reports", str(reports)))]
    assert kinds.count("indicator") == 2 and kinds.count("relationship") == 1


def test_query_as_text_and_json(run):
    text = run("demo")
    assert text[0] == "Query: wallet used by Grey Heron" and text[2].startswith("Cited: R-") and "Steps:" in text
    got = json.loads("\n".join(run("query", "--q", "wallet paid", "--k", "1", "--json")))
    assert got["citations"] == ["R-2"] and [t["tool"] for t in got["trace"]] == ["retrieve", "extract", "correlate", "summarize"]


def test_sources(run, spark, tmp_path):
    assert len(rows(run("sources-list"))) == len(CATALOG) and {r["category"] for r in rows(run("sources-list", "--category", "situational"))} == {"situational"}
    assert sum(r["feeds"] for r in rows(run("sources-stats"))) == len(CATALOG)
    url = next(r[2] for r in CATALOG if r[0] == "gdelt_conflict")
    content = json.dumps({"articles": [{"url": "u", "title": "Conflict at sea", "domain": "d", "seendate": "2024"}]})
    feed_source.fill_cache(spark.createDataFrame([(url, content)], "url string, content string"), str(tmp_path))
    got = rows(run("sources-ingest", "--offline", "--cache", str(tmp_path), "--feeds", "gdelt_conflict,cisa_advisories"))
    assert [r["text"] for r in got if "text" in r] == ["Conflict at sea (d)"] and [r["feed"] for r in got if "error" in r] == ["cisa_advisories"]
    live = run("demo-live", "--offline", "--cache", str(tmp_path))
    assert live[0] == "Query: conflict" and any("Cited: gdelt_conflict-" in x for x in live)


def test_image(run):
    got = rows(run("analyze-image"))
    assert sorted((r["row"], r["col"]) for r in got if "peak_snr" in r) == [(8.0, 9.0), (25.0, 30.0)] and "2 small bright target(s)" in got[-1]["text"]


def test_fusion_commands(run, tmp_path, capsys):
    page = tmp_path / "page.html"
    text = run("fuse", "--html", str(page))
    assert text[0] == "Common picture: harbour watch" and text[3].startswith("4 observations, 2 entities, 3 disciplines")
    assert "<svg" in page.read_text() and "never read" not in page.read_text()
    (d,) = rows(run("dossier", "--entity", "heron"))
    assert d["n_obs"] == 3 and {a["zone"] for a in d["zone_alerts"]} == {"quay"}
    with pytest.raises(SystemExit):
        cli.main(["dossier", "--entity", "nobody of that name"])
    assert "no entity matches" in capsys.readouterr().err
    out = tmp_path / "csv"
    run("export", "--format", "csv", "--out", str(out))
    assert sum(len(p.read_text().strip().split("\n")) for p in out.glob("part-*")) >= 4
