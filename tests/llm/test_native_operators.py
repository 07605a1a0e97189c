import textwrap

import pytest

from ticketloom.llm import license_scan as ls
from ticketloom.llm import license_texts, queries, url_rules


def test_known_texts_in_other_spellings(make):
    mit, zlib = license_texts.MIT, license_texts.ZLIB
    rows = [
        (1, "Copyright (c) 2020 A. N. Other\n\n" + mit), (2, mit.upper().replace("SUBLICENSE", "SUB-LICENCE")), (3, mit + " more"), (4, None),
        (5, ""), (6, "intro\nReleased under the MIT Licence\nLicensed under CC BY 4.0"), (7, zlib.replace("acknowledgment", "acknowledgement")),
        (7, zlib), (None, license_texts.ISC.replace("\n", "\r\n")),
    ]
    got = sorted(((r.doc_id or 0), r.license_id or "", r.notice_ids) for r in ls.scan(make(rows)).collect())
    assert got == [
        (0, "ISC", []), (1, "MIT", []), (2, "MIT", []), (3, "", []), (4, "", []), (5, "", []), (6, "", ["CC-BY-4.0", "MIT"]), (7, "Zlib", []), (7, "Zlib", []),
    ]
    assert ls.scan(make([])).count() == 0
    assert ls.scan_licenses(make(rows), {}, {}).where("license_id is not null or size(notice_ids) > 0").count() == 0


def test_known_texts_in_any_wrapping_below_titles_and_notices(make):
    rows, want = [], []
    for name, text in license_texts.TEXTS.items():
        blocks = text.split("\n\n")
        forms = [" ".join(text.split()), *("\n\n".join(textwrap.fill(b, n) for b in blocks) for n in (40, 72, 76, 79, 100)), "\n".join(text.split())]
        notices = ["Copyright (c) 2020 A. N. Other", "Copyright 2019-2021 Some Company, Inc.", "(c) 2020 X\nCopyright © Y", "© Z", "Copyright The Authors", "Copyright <year> <holder>"]
        forms += [f"{head}\n\n{forms[2]}" for head in [*license_texts.TITLES[name], *notices]]
        forms += [f"{t}\n\n{notices[0]}\n\n{forms[3]}" for t in license_texts.TITLES[name]] + [f"{license_texts.TITLES[name][0]}\n{notices[1]}\r\n\r\n{forms[2]}"]
        rows += [(len(rows) + i, f) for i, f in enumerate(forms)]
        want += [name] * len(forms)
    got = {r.doc_id: r.license_id for r in ls.scan(make(rows)).collect()}
    assert [(i, got[i]) for i in sorted(got)] == list(enumerate(want))
    mit = license_texts.MIT
    broken = [(1, mit.replace("COPYRIGHT HOLDERS BE LIABLE", "")), (2, mit.replace("COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "COPYRIGHT HOLDERS BE FREE"))]
    assert ls.scan(make(broken)).where("license_id is not null").count() == 0


def test_sql_is_the_same_function(spark, make):
    import duckdb

    from ticketloom.llm.oracle import license_scan as sql

    mit, isc = license_texts.MIT, license_texts.ISC
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 A\n\n" + mit), (2, "Copyright The Authors\n copyright b\n\ncopyright c\n\n" + isc), (3, "copyright holder x\ny\n\n" + isc),
        (4, "\ncopyright a\n   \n" + isc + "\n\n\tcopyright z"), (5, None), (6, ""), (7, "copyright"), (8, "a copyright\n\n copyright 2\n\nb\nLicensed under MIT."),
        (9, "x\r\n\r\nCopyright y\r\n\r\nz"), (10, "copyright a\n\ncopyright b\n\ncopyright c\n"), (None, mit), (1, mit + "\n\ncopyright the authors"),
    ]
    got = sorted(map(repr, (tuple(r) for r in ls.scan(make(rows)).collect())))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(map(repr, con.execute(sql()).fetchall()))
    ids = {r.doc_id: r.license_id for r in ls.scan(make(rows[:4])).collect()}
    assert ids == {1: "MIT", 2: "ISC", 3: None, 4: "ISC"}


def test_long_runs_of_lines(make):
    runs = ["copyright holder x\n" * 100_000, "\n" * 100_000, " " * 1_000_000, "copyright\n\n" * 100_000, "(c) 2020\n" * 100_000, "x\n\t " * 100_000, "copyright " * 100_000]
    got = ls.scan(make(list(enumerate(runs)))).collect()
    assert len(got) == len(runs) and all(r.license_id is None for r in got)
    assert {r.doc_id for r in got if r.n_canonical == 0} == {0, 1, 2, 3, 4, 6}


def test_texts_from_a_folder(spark, make, tmp_path):
    (tmp_path / "Apache-2.0.txt").write_text("Apache License\n\nTerms of use: do this.\n")
    (tmp_path / "MPL-2.0").write_text("Mozilla terms")
    texts = ls.license_folder(spark, str(tmp_path))
    assert sorted(texts) == ["Apache-2.0", "MPL-2.0"]
    got = ls.scan_licenses(make([(1, "APACHE LICENSE terms of use -- do this"), (2, "mozilla  terms"), (3, "terms")]), texts, {}).collect()
    assert {r.doc_id: r.license_id for r in got} == {1: "Apache-2.0", 2: "MPL-2.0", 3: None}


def test_rules_by_hand(spark):
    cases = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://example.net/de", "example.net", "/de", "net/", "block"),
        ("https://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
        ("https://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        ("https://example.com/fr/ads/1", "example.com", "/fr/ads/1", None, "block"),
        ("https://x.org/fr/ads/1", "x.org", "/fr/ads/1", "org/fr/", "allow"),
        ("https://x.net", "x.net", "", None, "allow"),
        ("https://x.net?y=http://z.net/", "x.net", "", None, "allow"),
        ("https://x.com/Track", "x.com", "/Track", None, "allow"),
        ("https://x.com/track", "x.com", "/track", None, "block"),
        ("no scheme.net/", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://", "", "", None, "allow"),
    ]
    rows = spark.createDataFrame([(i, u, "x", 1) for i, (u, *_) in enumerate(cases)] + [(0, cases[0][0], "x", 1)], "page_id long, url string, rule string, token int")
    got = sorted(tuple(r) for r in url_rules.judge_urls(rows, url_rules.production_rules()).collect())
    assert got == sorted([(i, *c[1:]) for i, c in enumerate(cases)] + [(0, *cases[0][1:])], key=lambda r: r[0])
    assert url_rules.judge_urls(rows, []).where("verdict <> 'allow'").count() == 0
    assert url_rules.judge_urls(rows.limit(0), url_rules.production_rules()).count() == 0


def test_rule_without_token_is_run_for_every_url(spark):
    rows = spark.createDataFrame([(1, "http://a.b/xx-yy"), (2, "http://a.b/z")], "page_id long, url string")
    rule = url_rules.pattern_rule("hyphen", "block", "-")
    assert {r.page_id: r.verdict for r in url_rules.judge_urls(rows, [rule]).collect()} == {1: "block", 2: "allow"}


@pytest.mark.parametrize("name", ["license_scan", "decontaminate", "url_rules"])
def test_main_path_runs_no_python(spark, name):
    plan = getattr(queries, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExternalRDD", "CartesianProduct"))
