"""HTML extraction, URL filters, license scans, chats, entry points."""

import functools
import importlib
import json
import random
import re
from collections import defaultdict

import pytest

from siteweave.llm import chat, html_text, licenses, url_filter

# html ---------------------------------------------------------------------------

PAGE = (
    "<html><head><title>T</title><script>var p='</p>';</script></head><body><header><h1>Site</h1></header><div id='cookie-notice'>We use cookies</div>"
    "<main><div class='post-12'><h1>A &amp; B</h1><p>One<br>two <b>three</b><p>Four &nbsp; five&#33;<ul><li>x<li>y</ul><!-- no --><div class=ad>buy</div>"
    "<form><input><p>mail</form><pre>a\n  b</pre></div></main><section class='comments'><p>nice post nice post</p></section><aside>s</aside><footer>f</footer>"
)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_text_of_a_page():
    assert html_text.text_of(PAGE, []) == "A & B\n\nOne two three\n\nFour five!\n\nx\n\ny\n\na b"


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<!-- open <p>x", ""), ("<p>1 < 2 &lt; 3</p>", "1 < 2 < 3"), ("<script>x", ""), ("<p title='a>b'>c</p>", "c"), ("<nav>n", "")],
)
def test_odd_pages(page, text):
    assert html_text.text_of(page, []) == text


def test_hosts_agree_on_a_container(spark):
    """One page of the host has more text beside the article than in it; the host's other pages decide."""
    body = lambda a, b: f"<body><div class='entry-{len(a)}'><p>{a}</p></div><div class='rest'><p>{b}</p></div></body>"
    rows = [(i, f"https://H.example/p{i}", body("the article text " * 9, "few")) for i in range(6)] + [(9, "https://h.example/q", body("short article text", "junk " * 40))]
    got = {r.page_id: r for r in html_text.extract(pages(spark, rows)).collect()}
    assert got[9].text == "short article text" and got[0].text == ("the article text " * 9).strip()
    assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1 class='entry-header'>T</h1><p>a</p></article>", "T\n\na"),
        ("<article><div class='notice-board'><p>a</p></div><section class='search-results-analysis'><p>b</p></section></article>", "a\n\nb"),
        ("<article><p>the sum <math><mi>x</mi></math> is</p></article>", "the sum x is"),
        ("<article><noscript><img src=x><p>a</p><p>b</p></article>", "a\n\nb"),
        ("<article><noscript>no</noscript><p>a</p><iframe src=y><p>b</p></article>", "a\n\nb"),
        ("<article><p>a<svg><g><svg><text>n</text></svg><text>n</text></g></svg> b</p><svg><p>c</p></article>", "a b\n\nc"),
        ("<article><template><p>n</p></template><div hidden><p>a</p></div><p aria-hidden=true style='display:none'>b</p></article>", "a\n\nb"),
        ("<article><p>a</p><div class='ad'>n</div><div class='ad-slot-3'>n</div><div id='related-links'>n</div><div class='post-comments'>n</div><div class='cookie-notice'>n</div></article>", "a"),
        ("<body><div class='content'><h1>T</h1><p>the introduction</p><div class='body'><p>most of the text is here</p></div></div></body>", "T\n\nthe introduction\n\nmost of the text is here"),
        ("<article><header>n</header><p>a</p><footer>n</footer><form>n</form><aside>n</aside></article>", "a"),
    ],
)
def test_only_furniture_is_dropped(page, text):
    assert html_text.text_of(page, []) == text


def made_page(rng, host, number):
    """A page of one of three host layouts, and its article as it was put in."""
    word = lambda: "".join(rng.choices("abcdefghijklmno", k=rng.randrange(2, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(3, 30))).capitalize() + rng.choice([".", " & co.", " 1 < 2."])
    article = [line() for _ in range(rng.randrange(1, 8))]
    coded = [html_text.html.escape(x).replace(" ", rng.choice([" ", "\n ", "&#32;", " <i></i>"])) for x in article]
    inner = f"<h1>{coded[0]}</h1>" + "".join(f"<p>{x}{rng.choice(['</p>', ''])}" for x in coded[1:])
    inner += rng.choice(["", f"<div class=ad>{line()}</div>", f"<aside>{line()}</aside>", "<script>if (a < b) x('</p>')</script>", f"<ul class='share-buttons'><li>{word()}</ul>"])
    around = f"<p>All content of host {host} is free to read by anyone.</p>"
    body = [
        f"<nav>{line()}</nav><article>{inner}</article><div>{around}</div><footer>{line()}</footer>",
        f"<div class='top menu'>{line()}</div><div class='story n{number}'>{inner}</div><div class='end'>{around}</div>",
        f"<header>{line()}</header><div class='page'><div class='text'>{inner}</div><section class='comments'><p>{line()}</p></section></div><div>{around}</div>",
    ][host % 3]
    return f"<html><head><title>{word()}</title><style>p {{}}</style></head><body>{body}</body></html>", "\n\n".join(article)


def test_made_pages_give_their_articles(spark):
    rng = random.Random(31)
    rows, want = [], {}
    for i in range(120):
        host = rng.choice([0, 0, 0, 1, 2])
        page, want[i] = made_page(rng, host, i)
        rows.append((i, f"https://h{host}.example/{i}", page))
    got = {r.page_id: r for r in html_text.extract(pages(spark, rows)).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_extraction_edge_cases(spark):
    rows = [(None, None, None), (1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (2, "x", ""), (3, "http://h/", "<p>" + "word " * 50_000)]
    df = pages(spark, rows).selectExpr("*", "1 as text", "2 as host", "3 as paths")
    got = sorted((r.page_id or 0, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 249_999)]
    assert html_text.extract(pages(spark, [])).count() == 0


# url filters --------------------------------------------------------------------


def plain_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not m else ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2])


def plain_rule(host, path):
    fits = []
    for verdict, text in url_filter.RULES:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(text), text, verdict))
    return max(fits)[1:] if fits else (None, None)


def plain_templates(paths):
    """Template of each path of one host, level by level."""
    shapes = [["*" if re.match(url_filter.VARIABLE, s) else s for s in p.split("/") if s] for p in paths]
    prefix = [""] * len(paths)
    for level in range(url_filter.LEVELS):
        children = defaultdict(lambda: defaultdict(int))
        for p, s in zip(prefix, shapes, strict=True):
            if len(s) > level:
                children[p][s[level]] += 1
        new = []
        for p, s in zip(prefix, shapes, strict=True):
            if len(s) > level:
                node = children[p]
                kept = len(node) < url_filter.MANY or 100 * node[s[level]] >= url_filter.LEAST_PERCENT * sum(node.values())
                p = f"{p}/{s[level] if kept else '*'}"
            new.append(p)
        prefix = new
    return [p + ("/**" if len(s) > url_filter.LEVELS else "") for p, s in zip(prefix, shapes, strict=True)]


def plain_shares(rows, bad):
    """Smoothed bad share of each (host, template)."""
    counts, hosts, pools = (defaultdict(lambda: [0, 0]) for _ in range(3))
    form = lambda t: re.sub(r"/[^/*]+", "/x", t)
    for page, host, template in rows:
        for key, table in (((host, template), counts), (host, hosts), ((host, form(template)), pools)):
            if page in bad:
                table[key][0] += 1
                table[key][1] += bad[page]
            else:
                table[key]
    n, b = sum(v[0] for v in counts.values()), sum(v[1] for v in counts.values())
    prior = b / n if n else 0.0
    w, merged, branch = url_filter.PRIOR_WEIGHT, defaultdict(lambda: [0, 0]), {}
    for (host, t), (m, k) in counts.items():
        pn, pb = pools[host, form(t)]
        alike = True
        if m and pn:
            q = pb / pn
            alike = abs(k / m - q) <= url_filter.ALIKE * (q * (1 - q) * (1 / m + 1 / pn)) ** 0.5
        branch[host, t] = (host, form(t), "" if alike else t)
        merged[branch[host, t]][0] += m
        merged[branch[host, t]][1] += k
    out = {}
    for host, t in counts:
        hn, hb = hosts[host]
        m, k = merged[branch[host, t]]
        out[host, t] = (k + w * (hb + w * prior) / (hn + w)) / (m + w)
    return out


def test_url_filter_like_brute_force(spark):
    rng = random.Random(11)
    hosts = ["a.example.com", "EXAMPLE.com", "x.example.net", "net", "b.org", "notorg", "c.test", "d.test"]
    rows, bad = [], {}
    for i in range(900):
        host = rng.choice(hosts)
        parts = [rng.choice(["en", "de", "es", "fr", "news"]), rng.choice(["7", "8", str(rng.randrange(999)), f"w{rng.randrange(30)}", "about", "0123456789abcdef0123"])]
        parts += [rng.choice(["p", "q"]) for _ in range(rng.choice([0, 0, 1, 4]))]
        rows.append((i, rng.choice(["http", "HTTPS"]) + f"://{host}/" + "/".join(parts) + rng.choice(["", "/", "?a=/b", "#x", ".html"])))
        if rng.random() < 0.6:
            bad[i] = int(rng.random() < (1.0 if parts[0] == "fr" and host.endswith(".test") else 0.1))
    rows += [(1000, None), (1001, "no host"), (1002, "http://"), (1003, "x://h?q"), (1004, "://only"), (None, "http://c.test/fr/1"), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, verdict string")
    marks = spark.createDataFrame([(k, v) for k, v in bad.items()] + [(None, 1), (4, None)], "page_id long, bad int")
    parsed = [(p, *plain_url(u)) for p, u in rows]
    by_host = defaultdict(list)
    for i, (_, h, p) in enumerate(parsed):
        by_host[h].append((i, p))
    template = {}
    for h, found in by_host.items():
        template |= dict(zip([i for i, _ in found], plain_templates([p for _, p in found]), strict=True))
    share = plain_shares([(p, h, template[i]) for i, (p, h, _) in enumerate(parsed)], bad)
    want = []
    for i, (p, h, path) in enumerate(parsed):
        rule, said = plain_rule(h, path)
        s = round(share[h, template[i]], 9)
        want.append((p, h, path, rule, said or ("block" if s >= url_filter.REJECT else "allow"), template[i], s))
    got = url_filter.filter_urls(df, marks).collect()
    key = lambda r: tuple("" if x is None else f"{x:.8f}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert {r.verdict for r in got if r.rule is None} == {"block", "allow"}
    assert url_filter.filter_urls(df.limit(0), marks).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, marks.limit(0), []).collect()} == {"allow"}


def judged_paths(spark, paths, bad):
    """Verdict of each path of one host; every page has a label."""
    df = spark.createDataFrame([(i, f"http://h.test{p}") for i, p in enumerate(paths)], "page_id long, url string")
    marks = spark.createDataFrame([(i, int(bad(p))) for i, p in enumerate(paths)], "page_id long, bad int")
    return {paths[r.page_id]: r.verdict for r in url_filter.filter_urls(df, marks, []).collect()}


@pytest.mark.parametrize("few", [True, False])
def test_small_sections_that_labels_set_apart(spark, few):
    """Thirty sections of 3.3 %, one unlike the others."""
    paths = [f"/section-{'abcdefghijklmnopqrstuvwxyzABCD'[i % 30]}/{i}" for i in range(600)]
    bad = lambda p: p.startswith("/section-c/") == few
    assert judged_paths(spark, paths, bad) == {p: "block" if bad(p) else "allow" for p in paths}


@pytest.mark.parametrize("tail", ["", "/a", "/7/x/y"])
def test_branches_below_the_named_levels(spark, tail):
    paths = [f"/en/2024/05/17{tail}/{s}/w{i}" for i in range(20) for s in ("casino", "news")]
    bad = lambda p: "casino" in p
    assert judged_paths(spark, paths, bad) == {p: "block" if bad(p) else "allow" for p in paths}


# licenses -----------------------------------------------------------------------


def plain_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    labels, best = set(base), 0.0
    for label, template in licenses.TEMPLATES:
        t, width = set(template.split()), -(-100 * len(template.split()) // licenses.CONTAINMENT)
        for i in range(len(words)):
            held = t & set(words[i : i + width])
            if 100 * len(held) >= licenses.CONTAINMENT * len(t):
                labels.add(label)
                best = max(best, len(held) / len(t))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best


def test_scan_like_brute_force(spark):
    rng = random.Random(12)
    texts = [
        None, "", "Under the MIT  License under-the\nmit license", "Apache License, Version 2.0", "cc by-nc 4", "thunder the mit license", "All rights reserved!",
        "This work is licensed under the GNU General Public License version three", "reserved: rights, all\nall rights\nreserved", "é" * 50_000 + " cc by nc", "İK under the mit license",
    ]
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    for _ in range(150):
        _, t = rng.choice(licenses.TEMPLATES)
        w = [x if rng.random() < 0.9 else rng.choice(vocabulary) for x in t.split()]
        texts.append(rng.choice([" ", ", ", "\t"]).join(w).upper() + rng.choice(["", "\nmore text under the mit license"]))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in licenses.scan(df).collect():
        want = plain_scan(texts[r.doc_id])
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
        assert got == want[:6] and r.score == pytest.approx(want[6]), texts[r.doc_id]
    assert licenses.scan(df.limit(0)).count() == 0


def test_scattered_words_and_long_lines(spark):
    """A line of filler with a template's words far apart is no notice; one very long line with a notice is."""
    filler = "other words in a line "
    scattered = (filler * 30).join(dict(licenses.TEMPLATES)["mpl-2"].split())
    whole = filler * 20_000 + dict(licenses.TEMPLATES)["mpl-2"] + " " + filler * 20_000
    got = licenses.scan(spark.createDataFrame([(1, scattered), (2, whole), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.labels, r.score) for r in got] == [("", 0.0), ("mpl-2", 1.0), ("", 0.0)]


def test_more_templates_than_one_expression_takes(spark, monkeypatch):
    monkeypatch.setattr(licenses, "TEMPLATES_AT_ONCE", 3)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    assert {r.doc_id: licenses.TEMPLATES[r.doc_id][0] in r.labels.split(",") for r in licenses.scan(df).collect()} == dict.fromkeys(range(len(licenses.TEMPLATES)), True)


def test_wrapped_notices(spark):
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
        "gpl-3": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by",
        "bsd-3": "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions\r\nare met:",
        "apache-2": " * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at",
    }
    filler = "other words\n" * 30
    spread = notices["mit"].split()
    texts = [f"{filler}{n}\n{filler}" for n in notices.values()] + [("\n" + filler).join(spread), " ".join(spread[:9]) + "\n" + filler]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(len(texts))] == [*notices, "", ""]
    assert all(got[i].score == 1.0 for i in range(4)) and got[0].n_base == 0


# chats --------------------------------------------------------------------------


def call(i, name="search", **arguments):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": arguments}) + "</tool_call>"


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "look " + call("a", query="x", limit=2.0)), (1, 2, "assistant", call("b", "fetch", url="$a")), (1, 3, "tool", result("b")), (1, 4, "tool", result("a", {"z": 1.50, "y": [2e3]})),
        (2, 0, "tool", result("a")), (2, 1, "assistant", call("a", query="")), (3, 0, "assistant", call("p", query="$q")), (3, 1, "assistant", call("q", query="$p")),
        (4, 0, "assistant", call("s", query="x")), (4, 1, "assistant", call("s", query="x")), (4, 2, "tool", result("s")), (5, 0, "tool", result("none")),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(chats(spark, rows)).collect()}
    place = lambda c: sorted((r for r in got.values() if r.conv_id == c), key=lambda r: (r.place_turn, r.place_level, r.place_step, r.turn))
    assert [r.turn for r in place(1)] == [0, 1, 4, 2, 3]
    assert [r.turn for r in place(2)] == [1, 0]
    assert got[1, 1].message == '{"content":"look","role":"assistant","tool_calls":[{"arguments":{"limit":2,"query":"x"},"id":"a","name":"search"}]}'
    assert json.loads(json.loads(got[1, 4].message)["content"]) == {"y": [2000], "z": 1.5}
    assert (got[1, 1].n_calls, got[1, 1].n_answered, got[1, 1].errors) == (1, 1, "")
    assert got[2, 1].errors == "$.query: too short" and got[2, 0].linked
    assert "cycle at p" in got[3, 0].errors and "cycle at q" in got[3, 1].errors
    assert got[4, 1].errors == "duplicate id s" and got[4, 0].errors == ""
    assert got[5, 0].errors == "no call for none" and got[5, 0].linked is False


def test_chat_edge_cases(spark):
    rows = [(None, None, None, None), (1, None, "assistant", call("a", query="x")), (1, 0, "user", '{"a": NaN}'), (1, 0, "user", '{"a": NaN}'), (2, 0, "assistant", "<tool_call>{bad</tool_call>"), (2, 1, "assistant", call("k", "odd")), (3, 0, "user", "x" * 100_000)]
    df = chats(spark, rows).selectExpr("*", "1 as calls", "2 as errors")
    got = chat.format_chats(df).collect()
    assert len(got) == len(rows)
    errors = sorted(r.errors for r in got if r.errors)
    assert errors == ["call: not JSON", "call: unknown tool; no result for k"]
    assert json.loads(next(r.message for r in got if r.conv_id is None)) == {"content": "", "role": None}
    assert chat.format_chats(df.limit(0)).count() == 0


def plain_chats(rows):
    """Links, levels and places by plain recursion over one conversation after another."""
    parsed = [(c, t, chat.parse_message(r, x, chat.SCHEMAS)) for c, t, r, x in rows]
    owner, results = {}, {}
    for c, t, m in sorted(parsed, key=lambda r: r[1]):
        for k in m["calls"]:
            owner.setdefault((c, k["id"]), (t, k["references"]))
        if m["answers"] is not None:
            results[c, m["answers"]] = max(t, results.get((c, m["answers"]), t))
    needs = defaultdict(set)
    for (c, i), (t, refs) in owner.items():
        needs[c, t] |= {(owner[c, r][0], results.get((c, r))) for r in refs if (c, r) in owner}

    @functools.lru_cache(None)
    def behind_cycle(c, t, path=()):
        return t in path or any(behind_cycle(c, n, (*path, t)) for n, _ in needs.get((c, t), ()))

    @functools.lru_cache(None)
    def placed(c, t):
        level, place = 0, t
        for n, result in needs.get((c, t), ()):
            a, b = placed(c, n)
            level, place = max(level, a + 1), max(place, b, result if result is not None else t)
        return level, place

    out = set()
    for c, t, m in parsed:
        mine = [k["id"] for k in m["calls"] if owner[c, k["id"]][0] == t]
        asked = owner.get((c, m["answers"]))
        turns = [t] if mine else [asked[0]] if asked else []
        level, place = 0, t
        for own in turns:
            a, b = (0, own) if behind_cycle(c, own) else placed(c, own)
            level, place = a, max(place, b)
        out.add((c, t, place, level, sum((c, i) in results for i in set(mine)), None if m["answers"] is None else asked is not None))
    return out


def tool_chats(rng, n, long):
    """Conversations with calls that refer to others, lost results, unknown and repeated ids; one of them long."""
    rows = []
    for c in range(n):
        turn, size = 0, long if c == 0 else rng.randrange(1, 9)
        for i in range(size):
            ids = [f"k{j}" for j in range(size)]
            refs = rng.sample(ids, rng.choice([0, 0, 1, 1, 2]) if size > 2 else 0)
            if c % 3:
                refs = [r for r in refs if int(r[1:]) < i]
            name = f"k{i}" if rng.random() < 0.9 else f"k{rng.randrange(size)}"
            rows.append((c, turn, "assistant", call(name, "calculate", op="add", args=[f"${r}" for r in refs])))
            turn += 1
            if rng.random() < 0.8:
                rows.append((c, turn, "tool", result(name if rng.random() < 0.9 else "lost")))
                turn += 1
    return rows


def test_chats_like_brute_force_and_sql(spark):
    import duckdb

    rng = random.Random(21)
    rows = tool_chats(rng, 40, 60)
    rows += rows[5:9]
    df = chats(spark, rows)
    got = chat.format_chats(df).collect()
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn, r.place_turn, r.place_level, r.n_answered, r.linked) for r in got} == plain_chats(rows)
    # the links in SQL
    con = duckdb.connect()
    con.execute("CREATE TABLE m (conv_id BIGINT, turn BIGINT, role TEXT, text TEXT)")
    con.executemany("INSERT INTO m VALUES (?, ?, ?, ?)", rows)
    sql = """
      WITH calls AS (SELECT conv_id, json_extract_string(regexp_extract(text, '<tool_call>(.*)</tool_call>', 1), '$.id') AS id FROM m WHERE contains(text, '<tool_call>')),
      results AS (SELECT conv_id, turn, json_extract_string(text, '$.tool_call_id') AS id FROM m WHERE role = 'tool')
      SELECT conv_id, turn, id, EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.id = r.id) FROM results r
    """
    want = sorted(con.execute(sql).fetchall())
    assert sorted((r.conv_id, r.turn, r.answers, r.linked) for r in got if r.answers is not None) == want


def test_a_long_chain_of_calls(spark):
    """Three hundred calls, each waiting for the one before: rounds are logarithmic."""
    n = 300
    rows = [(7, i, "assistant", call(f"c{i}", "calculate", op="add", args=[f"$c{i - 1}"] if i else [])) for i in range(n)]
    got = {r.turn: r.place_level for r in chat.format_chats(chats(spark, rows)).collect()}
    assert got == {i: i for i in range(n)}


def test_surrogates_and_deep_nesting(spark):
    deep = lambda n: "[" * n + "]" * n
    texts = [
        '{"tool_call_id":"1","content":"\\ud800"}',
        '<tool_call>{"id":"\\udc00","name":"search","arguments":{"query":"a\\ud800"}}</tool_call>',
        '{"tool_calls":[{"id":"d","name":"calculate","arguments":{"op":"add","args":%s}}]}' % deep(1500),
        '{"tool_calls":[{"id":"e","name":"search","arguments":%s}]}' % deep(100_000),
        '<tool_call>{"id":"f","name":"calculate","arguments":{"op":"add","args":%s}}</tool_call>' % deep(1500),
        deep(200_000),
    ]
    got = {r.turn: r for r in chat.format_chats(chats(spark, [(1, i, "assistant", t) for i, t in enumerate(texts)])).collect()}
    assert len(got) == len(texts)
    assert json.loads(got[0].message)["content"] == "\ud800" and "\\ud800" in got[0].message and not got[0].linked
    assert got[1].errors == "no result for \\udc00" and '"query":"a\\ud800"' in got[1].message
    for i, name in ((2, "d"), (4, "f")):
        assert got[i].errors in (f"no result for {name}", "message: nested too deep")
    assert json.loads(got[3].message)["content"] == texts[3] and got[3].n_calls == 0
    assert json.loads(got[5].message)["content"] == texts[5]


def test_open_ai_form_and_schemas():
    text = json.dumps({"content": None, "tool_calls": [{"id": 5, "type": "function", "function": {"name": "calculate", "arguments": '{"op":"pow","args":"no"}'}}]})
    m = chat.parse_message("assistant", text, chat.SCHEMAS)
    assert m["calls"][0]["errors"] == ["$.args: not of type array", "$.op: not one of the listed values"]
    assert chat.violations({"n": 3, "l": [1, "x"]}, {"properties": {"n": {"maximum": 2}, "l": {"items": {"type": "integer"}, "maxItems": 1}}}) == ["$.l: too many items", "$.l[1]: not of type integer", "$.n: above the maximum"]
    assert chat.canonical(chat.parsed('{"b":1.0,"a":[1e2,0.5,"é"]}')) == '{"a":[100,0.5,"é"],"b":1}'


# entry points -------------------------------------------------------------------


def test_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == before.columns and docs.schema.names == before.schema.names, name
        assert docs.subtract(before).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert packed.select("doc_id").distinct().count() == docs.count()
