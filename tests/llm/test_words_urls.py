"""Source audit, spelling variants and url filters against plain versions."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from footfall.llm import source_audit, spelling, url_filter
from footfall.llm.url_filter import Rule

# --- source audit


def plain_audit(rows, least=30, top=50):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        words = ["".join(c.lower() if c < "\x80" else c for c in w) for w in words]
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        own = p(count[lang, source])
        whole = p(sum((count[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for other in {s for x, s in groups if x == lang} - {source}:
            q = p(count[lang, other])
            pairs.append((other, sum(abs(own[t] - q[t]) for t in kept)))
        terms = [(t, own[t] - whole[t]) for t in kept if count[lang, source][t] and own[t] > whole[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, t, v, r) for r, (t, v) in enumerate(items[:most], 1)]
    return Counter(out)


AUDIT = "text STRING, lang STRING, source STRING, doc_id BIGINT, term STRING, n BIGINT"


def audit_frame(spark, rows, slices=3):
    return spark.createDataFrame([(*r, None, "x", 1) for r in rows], AUDIT).repartition(slices)


@pytest.mark.parametrize("cells, slice_bytes", [(1 << 20, 16 << 20), (7, 300)])
def test_source_audit(spark, monkeypatch, cells, slice_bytes):
    """Random texts over few and long words, groups without terms, nulls, a source with most rows; small blocks and slices."""
    monkeypatch.setattr(source_audit, "CELLS", cells)
    monkeypatch.setattr(source_audit, "SLICE_BYTES", slice_bytes)
    rng = np.random.default_rng(1)
    pool = ["a", "B", "abcdefgh", "abcdefghi", "Abcdefghij" * 3, "abcdefgh" * 4, "abcdefgh" * 3, "É", "é", "ßß", "日本語", "x1y", "ab", "zz"]
    rows = []
    for i in range(160):
        words = rng.choice(pool, rng.integers(0, 30))
        rows.append((" ".join(words), ["en", "fr", None][i % 3], f"s{max(int(rng.integers(0, 9)) - 4, 0)}"))
    rows += [(None, "en", "empty"), ("", "fr", None), ("12 34", "", "digits"), ("lone word", "xx", "one"), ("lone", "xx", "two"), rows[0], rows[0]]
    got = Counter(map(tuple, source_audit.audit(audit_frame(spark, rows), least_docs=9, top=4).collect()))
    assert got == plain_audit(rows, 9, 4)
    assert source_audit.audit(audit_frame(spark, []).limit(0)).count() == 0


def test_pointer_sort():
    rng = np.random.default_rng(3)
    for _ in range(60):
        words = [bytes(rng.choice(np.frombuffer(b"abz", np.uint8), rng.integers(1, 40) if rng.integers(2) else 8)) for _ in range(rng.integers(0, 60))]
        words += words[:10] + [b"q" * 5000] * 2
        part = np.sort(rng.integers(0, 3, len(words)))
        data = np.frombuffer(b" ".join(words) + b" " * 9, np.uint8)
        length = np.array([len(w) for w in words])
        start = np.cumsum(length + 1) - length - 1
        order, new = source_audit.sort_pointers(data, start, length, part)
        want = sorted(range(len(words)), key=lambda i: (part[i], words[i], i))
        assert order.tolist() == want
        assert new.tolist() == [k == 0 or (part[i], words[i]) != (part[want[k - 1]], words[want[k - 1]]) for k, i in enumerate(want)]


# --- spelling variants


def plain_words(rows, least_chars=5, least=3):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w if h % 97 else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    return {w: k for w, k in n.items() if len(w) >= least_chars and k >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) < len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[i + 1:] == (b[i + 1:] if len(a) == len(b) else b[i:])


def plain_variants(words):
    form, near = {}, {}
    for w, n in words.items():
        others = [o for o in words if one_edit(w, o)]
        near[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, near[w], words.get(form[w])))
    return out


def random_words(rng, alphabet, sizes, many):
    return ["".join(rng.choice(list(alphabet), rng.integers(*sizes))) for _ in range(many)]


@pytest.mark.parametrize("alphabet, sizes, many", [("ab", (5, 12), 120), ("abcdé", (4, 7), 250), ("aÀÿ", (5, 30), 150)])
def test_spelling_variants(spark, alphabet, sizes, many):
    rng = np.random.default_rng(many)
    words = random_words(rng, alphabet, sizes, many)
    for w in words[::2]:  # one or two edits away
        i = int(rng.integers(0, len(w)))
        words += [w[:i] + w[i + 1:], w[:i] + "a" + w[i:], w[:i] + "b" + w[i + 1:]]
    words += ["lengthy" * 300, "lengthy" * 299 + "lengthi", "x"]
    rows = [(i, " ".join(w.upper() if rng.integers(3) == 0 and w.isascii() else w for w in rng.choice(words, 90)) + "-1 ") for i in range(160)]
    rows += [(None, " ".join(words)), (3, None), (4, ""), rows[0], rows[0]] + [(900, " ".join(words[-4:]))] * 3
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id BIGINT, text STRING, word STRING, n BIGINT")
    want = plain_variants(plain_words(rows))
    got = [tuple(r) for r in spelling.variants(docs).collect()]
    assert len(got) == len(want) and set(got) == want and any(r[4] for r in got)
    assert spelling.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("least, most, dictionary", [(2, 3, 20_000), (2, 3, 3), (2, 4, 40), (3, 5, 15)])
def test_gram_lists_lose_no_pair(spark, least, most, dictionary):
    """Whatever the gram lengths and however hard the dictionary is pruned."""
    rng = np.random.default_rng(most)
    words = sorted({w for w in random_words(rng, "abc", (5, 9), 500)})
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word STRING, n BIGINT")
    pairs = [tuple(r) for r in spelling.near_pairs(frame, 5, least, most, dictionary).collect()]
    want = {(a, i, b, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)}
    assert len(pairs) == len(want) and set(pairs) == want


# --- url filters

RULES = [Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
PAGES = [
    (1, "http://A.NET/x", "<p>"), (2, "http://a.com/x#f", "<head><link rel='Canonical' href='//a.net/y'></head>"),
    (3, "http://b.com/q?x=1", "<meta http-equiv=refresh content=\"0; URL='http://a.com/x'\">"),
    (4, "http://c.org/fr/", "<link href='http://b.com/q?x=1#z' rel=canonical>"),
    (5, "http://c.com", "<!-- <link rel=canonical href='http://a.net/'> --><body><link rel=canonical href='http://a.net/'>"),
    (6, None, None), (7, "no scheme", "<link rel=canonical href=http://a.net/>"), (8, "http://x.example.net/en/p", None),
    (9, "http://xexample.net/en/p", ""), (9, "http://foo.net", ""), (None, "HTTP://a.com/x", None),
    (10, "http://d.com/a/b", "<link rel=canonical href='http://[bad'><base href='http://a.com/'><link rel=canonical href=x><![x"),
    (11, "http://e.org/fr/x://y?://#", None), (12, "http://k.com/" + "a" * 50_000, "<link rel=canonical href='http://l.com/'>"),
    (13, "http://l.com/", "<html>"), (14, "https://example.com/de/?q", ""), (14, "https://example.com/de?q", ""), (15, "ftp://u:p@h.net:21/", ""),
]
WANT = [
    (1, "a.net", "/x", "net/", "block"), (2, "a.com", "/x", None, "block"), (3, "b.com", "/q", None, "block"),
    (4, "c.org", "/fr/", "org/fr/", "allow"), (5, "c.com", "", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
    (8, "x.example.net", "/en/p", "example.net/en/", "allow"), (9, "xexample.net", "/en/p", "net/", "block"), (9, "foo.net", "", None, "allow"),
    (None, "a.com", "/x", None, "block"), (10, "d.com", "/a/b", None, "block"), (11, "e.org", "/fr/x://y", "org/fr/", "allow"),
    (12, "k.com", "/" + "a" * 50_000, None, "allow"), (13, "l.com", "/", None, "allow"), (14, "example.com", "/de/", "example.com/de/", "block"),
    (14, "example.com", "/de", None, "allow"), (15, "u:p@h.net:21", "/", None, "allow"),
]
SCHEMA = "page_id BIGINT, url STRING, html STRING"


def test_url_rules_and_aliases(spark):
    pages = spark.createDataFrame([(*p, "h", "v", "n") for p in PAGES], SCHEMA + ", host STRING, verdict STRING, node STRING")
    assert Counter(map(tuple, url_filter.judge(pages, RULES).collect())) == Counter(WANT)
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    # a crawler's redirect joins the allowed pair to a blocked url that is no page
    redirects = spark.createDataFrame([("http://l.com/", "http://m.net/z"), (None, "http://m.net/z"), ("bad", None)], "url STRING, target STRING")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, RULES, redirects).collect()}
    assert got[12] == got[13] == "block" and got[5] == "allow"


def test_longest_rule_wins(spark):
    rules = [Rule("block", "a.com"), Rule("allow", "a.com", "/x/"), Rule("block", "a.com", "/x/y"), Rule("allow", "b.a.com"), Rule("block", "b.a.com")]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(("http://a.com/", "http://a.com/x/", "http://a.com/x/yz", "http://b.a.com/"))], SCHEMA)
    got = [(r.rule, r.verdict) for r in url_filter.judge(pages, rules).orderBy("page_id").collect()]
    assert got == [("a.com/", "block"), ("a.com/x/", "allow"), ("a.com/x/y", "block"), ("b.a.com/", "allow")]


def test_alias_chains_and_hubs(spark):
    """A chain of 40 redirects, and a hub with 300 pages, each tied to one blocked url; a second hub stays allowed."""
    def canonical(t):
        return f'<link rel="canonical" href="{t}">'

    rows = [(i, f"http://c.com/{i}", canonical(f"http://c.com/{i + 1}")) for i in range(40)] + [(40, "http://c.com/40", canonical("http://bad.net/"))]
    rows += [(100 + i, f"http://h.com/{i}", canonical("http://hub.com/")) for i in range(300)] + [(99, "http://hub.com/", canonical("http://x.net/"))]
    rows += [(500 + i, f"http://g.com/{i}", canonical("http://good.com/")) for i in range(50)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, SCHEMA), RULES).collect()}
    assert {i for i, v in got.items() if v == "block"} == {i for i, *_ in rows if i < 500}
