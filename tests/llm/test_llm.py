"""The ten operators against brute force on small tables, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import _util, ann, decontam, html, langid, licenses, linedup, mixing, ngramjoin, queries, substr, urlfilter

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, **cols):
    rows = [(i, t, cols.get("lang", "en"), f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = [words(rng, 120) for _ in range(12)]
    out = [" ".join(b) for b in base]
    for b in base[:6]:
        near = list(b)
        near[10] = "changed"
        out += [" ".join(near), " ".join(b), " ".join(words(rng, 30) + b[20:60] + words(rng, 10))]
    return [*out, None, "", "  \n\t", "one", "a b c d", "a b c d", "x" * 50_000, " ".join(words(rng, 5000))]


# Connected components


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 150), (7, 7)]
    got = dict(_util.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 150, 150: 150}


def test_components_of_nothing(spark):
    assert _util.connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


# 1 HTML


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><article><h1>{h}</h1><p><b>{a}<br><p>{b}</p></article><footer>&copy; x</footer></body></html>'


def test_article_text():
    got = html.extract_group([PAGE.format(h="Head &amp; line", a="First  block\n text", b="Sec&ouml;nd <i>it</i>."), None, ""])
    assert [t for t, _ in got] == ["Head & line\nFirst block text\nSecönd it.", "", ""]


def test_regions_inside_the_article_are_dropped():
    page = '<article><header><h1>T</h1></header><p>A</p><aside>S</aside><div class="comments"><p>C</p></div><form><p>F</p></form><div id="cookie-notice">N</div><p>B<script>x</script></p><p hidden>H</p></article>'
    assert html.extract_group([page])[0][0] == "T\nA\nB"


def test_template_without_an_article():
    page = "<body><div class=a><p>Same on all</p></div><div class=b><p>{}</p></div></body>"
    got = html.extract_group([page.format(f"text {i}") for i in range(6)])
    assert [t for t, _ in got] == [f"text {i}" for i in range(6)]
    assert all(n > 0 for _, n in got)


def test_html_keeps_every_row(spark):
    rows = [(i if i % 5 else None, f"http://{'hot' if i % 3 else i}.com/{i}", PAGE.format(h=i, a="a", b="b") if i % 11 else None) for i in range(300)] + [(1, None, "<p>x")] * 2
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert Counter((r.page_id, r.url) for r in got.collect()) == Counter((p, u) for p, u, _ in rows)
    assert html.extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# 2 lines


def line_sets(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    lines = [" ".join(words(rng, 25)) for _ in range(30)]
    near = [x.replace(x.split()[5], "zz", 1) for x in lines[:10]]
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, 30, 3)] + ["\n".join(near[i : i + 2] + ["", "short", lines[3]]) for i in range(0, 10, 2)] + [None, "", "short\nshort"]
    flat = [(d, p, x.strip()) for d, t in enumerate(texts) if t for p, x in enumerate(t.split("\n")) if x.strip()]
    uniq = list(dict.fromkeys(x for _, _, x in flat))
    root = {x: x for x in uniq}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(uniq):
        for b in uniq[:i]:
            s, t = line_sets(a), line_sets(b)
            if len(s & t) >= 0.8 * len(s | t):
                root[find(a)] = find(b)
    seen, want = set(), defaultdict(list)
    for d, t in enumerate(texts):
        for p, x in enumerate(t.split("\n") if t is not None else []):
            key = find(x.strip()) if x.strip() else (d, p)
            if key not in seen or not x.strip():
                want[d].append(x)
            seen.add(key)
    got = {r.doc_id: r for r in linedup.dedup_lines(docs(spark, texts)).collect()}
    for d, t in enumerate(texts):
        assert got[d].text == (None if t is None else "\n".join(want[d])), d
        assert got[d].n_kept == len(want[d]) and got[d].n_lines == (0 if t is None else len(t.split("\n")))


def test_line_dedup_edges(spark):
    empty = spark.createDataFrame([], DOC)
    assert linedup.dedup_lines(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c\nx", 1), (5, "a b c", 2), (5, "a b c", 2)], "doc_id bigint, text string, n_kept int")
    got = sorted((r.doc_id or -1, r.text) for r in linedup.dedup_lines(df).collect())
    assert got == [(-1, "x"), (5, "a b c"), (5, "a b c")]


def test_line_dedup_of_odd_rows(spark):
    # Columns that clash with inner names, very long lines, ties of doc_id, repeated rows, empty texts.
    long = "".join(chr(97 + i * i % 23) + ("z" if i % 7 else " ") for i in range(150_000))
    rows = [(1, long, 1, "x", None), (2, "first\n" + long + "!", 2, "y", [1]), (3, "", 3, "z", None), (3, "other text, long enough", 4, None, None), (3, "same text, long enough\nother text, long enough", 5, None, [2]), (3, "other text, long enough", 4, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, d int, gone string, th array<int>")
    got = [(r.doc_id, r.text, r.d, r.gone, r.th, r.n_lines, r.n_kept) for r in linedup.dedup_lines(df).collect()]
    other = (3, "other text, long enough", 4, None, None, 1, 1)
    want = [(1, long, 1, "x", None, 1, 1), (2, "first", 2, "y", [1], 2, 1), (3, "", 3, "z", None, 1, 1), other, other, (3, "same text, long enough", 5, None, [2], 2, 1)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_line_dedup_does_not_hang_on_partitions(spark):
    rng = random.Random(6)
    lines = [" ".join(words(rng, 20)) for _ in range(20)]
    texts = ["\n".join(x.replace(x.split()[rng.randrange(20)], "zz", 1) for x in rng.sample(lines, 4)) for _ in range(40)]
    df = docs(spark, texts)
    one = sorted(map(str, linedup.dedup_lines(df.coalesce(1)).collect()))
    assert one == sorted(map(str, linedup.dedup_lines(df.repartition(7)).collect()))


def test_signatures_find_pairs_as_often_as_stated():
    rng = random.Random(9)
    n = hits = 0
    while n < 400:
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(60, 300)))
        b = list(a)
        for _ in range(max(1, len(a) // 75)):
            b[rng.randrange(len(b))] = "#"
        b = "".join(b)
        s, t = line_sets(a), line_sets(b)
        if 0.8 <= len(s & t) / len(s | t) <= 0.83:
            n += 1
            x = linedup.signatures([a, b])
            hits += bool((x[0] == x[1]).any())
    assert hits >= 0.99 * n


# 3 language


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = langid.identify_by_own_labels(df).where(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.lang_score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(1, "das ist ein haus und der hund", "de", 1), (2, "this is the house and a dog", "en", 2), (3, None, "en", 3), (4, "123 !!", "en", 4), (5, "der hund ist im haus", None, 5), (6, "x", "en", 6), (None, "the dog", "en", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_score int")
    model = langid.train(df)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert got[3] == got[4] == "und" and got[5] == "de" and got[2] == "en" and got[6] in ("de", "en")
    assert langid.identify(df.limit(0), langid.train(df.limit(0))).count() == 0
    assert [r.h for r in df.select(langid.held_out(F.col("doc_id")).alias("h")).collect()][:3] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 2, 3)]


# 4 decontamination


def test_decontamination(spark):
    rng = random.Random(2)
    items = [" ".join(words(rng, n, 5000)) for n in (15, 30, 50, 4)]
    sub = items[1].split()
    for i in range(4, 30, 6):
        sub[i] = "other"
    clean = [" ".join(words(rng, 300, 5000)) for _ in range(20)]
    texts = [f"{clean[0]} {items[0]} {clean[1]}", f"{clean[2]} {' '.join(sub)}", f"{items[2].upper()}, {clean[3]}", f"{clean[4]} {' '.join(items[2].split()[10:26])} {clean[5]}", f"{clean[6]} {items[3]} end", *clean[7:], None, ""]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (None, "x y"), (10, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(docs(spark, texts), bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 3)}
    assert decontam.find_contamination(docs(spark, texts), bench.limit(0)).count() == 0


def test_best_stretch_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(2) for _ in range(25)]
        b = [rng.choice([x, x, x, 1 - x]) for x in a]
        good = [sum(a[k] == b[k] for k in range(i, j)) for i in range(26) for j in range(i + 12, 26) if sum(a[k] == b[k] for k in range(i, j)) >= 0.8 * (j - i)]
        got = decontam.best_stretch(a, b)
        assert bool(got) <= bool(good)
        if got:
            assert got[2] >= 0.8 * (got[1] - got[0]) - 1e-9 and got[1] - got[0] >= 12


# 5 substrings


def brute_substrings(texts):
    seen, out = {}, []
    for d, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.setdefault(key, (d, i))
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [substr.HOT, 2])
def test_substrings_against_brute_force(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(substr, "HOT", hot)
    texts = [*corpus, "a " * 100, ("q " + "b " * 45) * 2, corpus[0] + "\u00a0" + corpus[1]]
    got = substr.dedup_digest(docs(spark, texts))
    assert sorted(tuple(r) for r in got.collect()) == brute_substrings(texts)


def test_substrings_edges(spark):
    assert substr.dedup_digest(spark.createDataFrame([], DOC)).count() == 0
    t = " ".join(f"u{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (4, t)], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_removed) for r in substr.dedup_digest(df).collect())
    assert got == {(3, 0): 2, (4, 30): 1, (None, 30): 1}


# 6 neighbours


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = ann.search(df, df.where("vec_id % 100 = 0")).collect()
    pdf = df.toPandas().sort_values("vec_id")
    x = np.stack(pdf.embedding).astype(np.float64)
    ids = pdf.vec_id.to_numpy()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        top = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits += len(top & {v for v, _ in found})
        assert len(found) == 20 and [c for _, c in found] == sorted((c for _, c in found), reverse=True)
        assert all(abs(c - s[ids == v][0]) < 1e-12 for v, c in found)
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_edges(spark):
    v = lambda *a: list(map(float, a))
    rows = [(1, v(1, 0)), (2, v(1, 0)), (3, v(0, 1)), (4, None), (5, v(0, 0)), (6, [1.0, None]), (7, v(float("nan"), 1)), (8, v(1, 2, 3)), (None, v(1, 1)), (20, v(1, 0)), (20, v(1, 0))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id % 20 = 0")).collect()]
    assert sorted(got) == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 0.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


# 7 similar documents


def brute_similar(texts):
    def sets(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    s = [sets(t) for t in texts]
    links = defaultdict(set)
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(s)))
    for _ in s:
        for i in links:
            for j in links[i]:
                root[i] = root[j] = min(root[i], root[j])
    return [(i, root[i], len(links[i])) for i in range(len(s))]


@pytest.mark.parametrize("block", [512, 3])
def test_similar_documents(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK_CLASSES", block)
    rng = random.Random(9)
    base = words(rng, 150, 5000)
    chain = []
    for _ in range(14):
        base = list(base)
        base[rng.randrange(150)] = f"n{rng.random()}"
        chain.append(" ".join(base))
    texts = [*corpus, *chain]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngramjoin.similar_documents(docs(spark, texts)).collect())
    assert got == brute_similar(texts)


def test_similar_edges(spark):
    assert ngramjoin.similar_documents(spark.createDataFrame([], DOC)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, None)], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngramjoin.similar_documents(df).collect())
    assert got == {(None, 2, 2): 1, (2, 2, 2): 2, (3, 3, 0): 1}
    b, r = ngramjoin.band_plan()
    assert 1 - (1 - 0.8**r) ** b >= ngramjoin.RECALL


# 8 urls


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [k for k in urlfilter.RULES if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
    rule = max(fit, key=len, default=None)
    blocked = any(host == b or host.endswith("." + b) for b in urlfilter.BLOCKED_HOSTS)
    return host, path, rule, urlfilter.RULES[rule] if rule else "block" if blocked else "allow"


def test_urls_against_brute_force(spark):
    rng = random.Random(6)
    urls = [f"{rng.choice(['http', 'ftp'])}://{rng.choice(['', 'www.', 'A.b.', 'not'])}{rng.choice(['example.com', 'EXAMPLE.net', 'x.org', 'com', 'spam-farm.example.org', 'free-bets.example.com'])}{rng.choice(['', '/', '/en/7', '/en/71?x', '/en/8#y', '/de/8', '/de/9', '/es/', '?q=/en/', ':80/en/'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "a://b://c/en/", "http://com/en/\nx", "http://..com/en/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, urlfilter.RULES, urlfilter.BLOCKED_HOSTS).collect()}
    joined = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter._judge_by_join(df, urlfilter.RULES, urlfilter.BLOCKED_HOSTS, "url").collect()}
    for i, u in enumerate(urls):
        assert got[i] == joined[i] == brute_url(u), u


def test_fixed_rules_have_the_words_of_the_contract(spark, tmp_path):
    """The contract's list, written out here and not taken from the code."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"),
        "http://www.example.com/en/71": ("example.com/en/7", "allow"),
        "http://a.net/de/1": ("net/de/", "allow"),
        "http://example.net/de/9": ("net/de/", "allow"),
        "http://spam.cheap-pills.net/de/": ("net/de/", "allow"),
        "http://adult-x.example.net/de/7": ("net/de/", "allow"),
        "http://m.example.net/de/81?x": ("example.net/de/8", "block"),
        "http://b.org/es/": ("org/es/", "block"),
        "http://adult-x.example.net/fr/": (None, "block"),
        "http://a.net/fr/": (None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id bigint, url string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op8_url_filter(spark, str(tmp_path)).collect()}
    joined = {r.page_id: (r.rule, r.verdict) for r in urlfilter._judge_by_join(pages, urlfilter.RULES, urlfilter.BLOCKED_HOSTS, "url").collect()}
    assert got == joined == dict(enumerate(want.values()))


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(5000)]
    listed, universe = (spark.createDataFrame([(k,) for k in ks], "key string") for ks in (keys[::7], keys))
    c = urlfilter.build_cascade(listed, universe)
    assert len(c.levels) > 1
    assert {r.key for r in universe.where(c.contains(F.col("key"))).collect()} == set(keys[::7])
    none = urlfilter.build_cascade(listed.limit(0), universe)
    assert universe.where(none.contains(F.col("key"))).count() == 0


# 9 mixing


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)) if i % 50 else None, rng.choice(["a", "b", "c", "d", None]) if i > 20 else "tiny") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_sources(df).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    total, target, full = sum(size.values()), {}, set()
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    while True:
        rest = total - sum(3 * size[s] for s in full)
        level = rest / sum(w for s, w in weight.items() if s not in full)
        target = {s: 3 * size[s] if s in full else level * w for s, w in weight.items()}
        more = {s for s in weight if s not in full and target[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, target[r.source]) and r.source_size == size[r.source] and r.taken <= 3 * r.size
        assert r.taken in {r.epochs * r.size}
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 40 for s in size)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_mixing_edges(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOC)).count() == 0
    df = spark.createDataFrame([(1, None, "a"), (None, "x y", None), (1, "q", "a"), (1, "q", "a")], "doc_id bigint, text string, source string")
    assert mixing.mix_sources(df, spark.createDataFrame([(1, 2.0), (1, 3.0), (None, 1.0)], "doc_id bigint, weight double")).count() == 4


# 10 licences


def test_licences(spark):
    texts = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3. gnu general public license gnu general public license", "Licensed under the Apache License, Version 2.0.", "MIT-license MIT\u00a0license", None, "", "plain text", "x " * 20_000 + "mit license"]
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        want = sorted((label, k, k + len(p.split())) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert rows[i].n_words == len(w) and sorted(tuple(b) for b in rows[i].base) == want, t
    labels = lambda i: {f.label for f in rows[i].found}
    assert "mit" in labels(0) and "cc-by-nc" in labels(1) and "cc-by" not in labels(1) and "gpl-3" in labels(2) and labels(3) == {"apache-2.0"} and not labels(7)
    assert len(licenses.default_rules()) > 200


def test_resolution_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        found = [("r", "l", s := rng.randrange(20), s + rng.randrange(1, 6), rng.randrange(3), 1.0) for _ in range(8)]
        out = []
        for d in sorted(found, key=lambda d: (-d[4], d[2] - d[3], d[2])):
            if not any(o[2] <= d[2] and d[3] <= o[3] for o in out):
                out.append(d)
        assert sorted(licenses.resolve(found)) == sorted(out)


# Pipeline


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline as p

    clean = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, d, sf_dir)
        if i < len(p.STAGES) - 1:
            assert out.columns == list(p.COLUMNS)
            out.write.parquet(str(tmp_path / str(i)))
            d = spark.read.parquet(str(tmp_path / str(i)))
            assert 0 < d.count() <= len(clean)
    assert out.where("taken > 3 * size").count() == 0
    assert p.run(spark, sf_dir).count() == out.count()


def test_every_query_keeps_its_rows(spark, sf_dir):
    n = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, table in (("op1_html_extraction", "pages"), ("op2_line_dedup", "documents"), ("op3_language_id", "documents"), ("op5_substring_dedup", "documents"), ("op7_ngram_jaccard_join", "documents"), ("op8_url_filter", "pages"), ("op9_source_mixing", "documents"), ("op10_license_scan", "documents")):
        assert queries.QUERIES[name](spark, sf_dir).count() == n[table], name
