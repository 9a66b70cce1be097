"""The ten operators against brute force on small tables, and on nulls, empty texts, repeats and clashing columns."""

import base64
import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lodestar.llm import decontam, html_extract, line_dedup, lm_score, near_dedup, packing, quality, queries, secret_scan, url_filter, warc

FOLDER = "/root/testdata/sf0.001"
SPACE = re.compile("[ \t-\r]+")


def words(text, lower=True):
    text = text or ""
    text = "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in text)
    return [w for w in SPACE.split(text) if w]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "a b c d e f", "en", "s", 11, 1), (1, None, None, None, None, 2), (2, "", "en", "s", 0, 3), (3, " \t\n\n ", "xx", "s", 5, 4), (4, long, "en", "s", len(long), 5), (5, "same line of some words here\nsame line of some words here", "en", "s", 57, 6), (5, "same line of some words here\nsame line of some words here", "en", "s", 57, 6), (6, "ünï 😀 <|endoftext|> it's ÀÉ x", "en", "s", 30, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep int")


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(None, "HTTP://A.org/x?q", "<p>hi</p>", 1), (1, None, None, 2), (2, "nothing", "", 3), (3, "http://Example.org/es/1", "<p>hi</p>", 4), (3, "http://Example.org/es/1", "<p>hi</p>", 4), (4, "http://b.com", "<article><p>A &amp; b<nav>no</nav></article", 5)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host int")


def test_line_dedup_matches_brute_force(documents, texts):
    want, seen = set(), []
    for i in sorted(texts):
        for no, line in enumerate((texts[i] or "").split("\n")):
            s = {w for w in SPACE.split(line.lower()) if w}
            if not s:
                continue
            if any(100 * len(s & t) >= 80 * len(s | t) for t in seen if 4 * len(s) <= 5 * len(t) and 4 * len(t) <= 5 * len(s)):
                want.add((i, no))
            seen.append(s)
    assert {tuple(r) for r in line_dedup.matches(documents).collect()} == want


def test_url_filter_matches_duckdb(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    got = url_filter.judge(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    want = connection.execute(f"SELECT {', '.join(got.columns)} FROM ({url_filter.oracle_sql()})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_url_templates_branch_and_decide(spark):
    rules = (("block", "a.com", "/shop/x"), ("allow", "a.com", "/news/x"))
    paths = [f"/shop/x{k}" for k in range(30)] + [f"/news/x{k}/a/b" for k in range(30)]
    free = {f"/shop/{k}": "block" for k in range(20)} | {f"/news/{k}/a/b": "allow" for k in range(20)}
    urls = [f"http://a.com{p}" for p in [*paths, *free]] + [f"http://b.com/{s}/{k}" for s, n in (("en", 60), ("fr", 6), ("es", 7)) for k in range(n)] + ["http://c.com/1/2/3", "http://c.com", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.judge(pages, rules=rules).collect()
    assert len(rows) == len(urls)
    assert {r.path: r.verdict for r in rows if r.host == "a.com" and r.rule is None} == free
    assert {r.template for r in rows if r.host == "a.com"} == {"/shop/*", "/news/*/a/b"}
    assert {(r.path.split("/")[1], r.template) for r in rows if r.host == "b.com"} == {("en", "/en/*"), ("fr", "/*/*"), ("es", "/*/*")}
    assert {r.template for r in rows if r.host in ("c.com", "")} == {"/**"}


def test_secret_base_spans(documents, texts):
    got = {r.doc_id: r for r in secret_scan.scan(documents).collect()}
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, text in texts.items():
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        spans = [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(got[i].spans.split(",")) | {""}
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(f[2] == k for f in found) for k in ("assign", "access", "hex"))


def test_secret_tests_find_random_strings_and_leave_written_ones(spark):
    alphabets = {"hex": "0123456789ABCDEF", "lower": "abcdefghijklmnopqrstuvwxyz", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    random, planted, rows = np.random.default_rng(5), {}, []
    for name, alphabet in alphabets.items():
        for k in range(60):
            planted[len(rows)] = name
            rows.append("".join(random.choice(list(alphabet), 24 + k % 41)))
    written = "the bridge over the river was built by people of this town in one dry summer and stood there for two hundred years until water rose above its road".split()
    for k in range(300):
        chosen = [str(w) for w in random.choice(written, 6)]
        rows.append([str.join("-", chosen), "".join(w.title() for w in chosen), "".join(chosen), "/".join([*chosen, "2024", "11"]), "_".join(chosen).upper()][k % 5])
    rows += ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "x" * 40, "1234567890" * 4, "=" * 30, "-" * 25 + "=="]
    docs = spark.createDataFrame([(i, f"see {x} here") for i, x in enumerate(rows)], "doc_id long, text string")
    out = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    found = Counter(planted[i] for i in planted if out[i].n_random)
    assert all(found[name] >= 54 for name in alphabets), found
    assert sum(out[i].n_random for i in range(len(planted), len(rows))) <= 3
    assert all(f"random:4:{4 + len(rows[i])}" == out[i].spans for i in planted if out[i].n_random and not out[i].n_hex)


def test_secret_scan_grows_with_its_texts(spark):
    random = np.random.default_rng(3)
    code = lambda alphabet, n: "".join(random.choice(list(alphabet), n))
    full = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def scanned(size):
        blob, free = code(full, 20 + size * 5), [code(full, 30) for _ in range(size)]
        hexes, assigned = [code("0123456789abcdef", 40) for _ in range(size)], [f"token={code(full, 24)}" for _ in range(size)]
        mixed = "\n".join(x for group in zip(free, hexes, assigned, strict=True) for x in group)
        docs = spark.createDataFrame([(0, f"é {blob}"), (1, mixed)], "doc_id long, text string")
        began = time.time()
        out = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
        took = time.time() - began
        assert out[0].spans in ("", f"random:2:{2 + len(blob)}")
        assert (out[1].n_assign, out[1].n_access, out[1].n_hex) == (size, 0, size)
        starts = {mixed.index(x): (kind, x) for kind, group in (("random", free), ("hex", hexes), ("assign", assigned)) for x in group}
        spans = [span.split(":") for span in out[1].spans.split(",")]
        assert all(starts[int(a)] == (kind, mixed[int(a) : int(b)]) for kind, a, b in spans)
        assert sum(kind == "random" for kind, _, _ in spans) == out[1].n_random >= 0.9 * size
        return took

    scanned(1)
    small = scanned(1)
    assert scanned(200) < 3 * small + 5


def _packed(docs, texts_of):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    rows = packing.pack(docs, queries.TOKENIZER).collect()
    want = Counter()
    for i, text in texts_of:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    return len(by), sum(r.length for r in rows)


def test_packing(documents, texts, odd):
    sequences, tokens = _packed(documents, texts.items())
    assert sequences <= math.ceil(tokens / 4096) + 2
    _packed(odd, [(r.doc_id, r.text) for r in odd.collect()])


def test_near_dedup_matches_brute_force(documents, texts):
    sets = {i: ({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}) for i, w in ((i, words(t)) for i, t in texts.items())}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(documents).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_dedup_links_in_lists_of_three(spark):
    sets = {1: (1, 2, 3, 4, 6, 7, 8), 2: (1, 2, 3, 4), 3: (1, 2, 3, 4, 5), 4: (6, 7, 8, 9, 10, 11, 12)}
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in s)) for i, s in sets.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.groups(docs, shingle=1).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4}


def test_near_dedup_links_by_one_common_value(spark):
    names = [f"w{k}" for k in range(9000)]
    hashed = near_dedup.mixed(near_dedup.hashes(pa.array(names)))
    low = [names[i] for i in np.argsort(near_dedup.windows(hashed, 1))]
    a, b, one, both, rest = low[:9], low[9:18], low[18], low[19:91], iter(low[91:])
    sets = {0: [*a, one, *both], 1: [*b, one, *both]}  # 73 of 91 shared; of the smallest ten each, one
    for i in range(90):
        sets[i + 2] = [*(a if i % 2 else b), one, *(next(rest) for _ in range(80))]
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in sets.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.groups(docs, shingle=1).collect()}
    assert got == {i: 0 if i == 1 else i for i in sets}


def test_html():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Head &amp; more</h1><p>One\n two <b>three</b></p><div class='comments'><p>me too</p></div><script>x()</script></article><footer>f</footer></body></html>"
    assert html_extract.main_text(page) == "Head & more\n\nOne two three"
    assert html_extract.main_text("") == "" == html_extract.main_text("<nav>only</nav>")


def test_html_without_semantic_tags():
    story = ["The bridge over the river was built by the people of the town in a single dry summer.", "It stood for two hundred years.", "Then, one night in March, the water rose above the road and took three of its arches away."]
    page = (
        "<html><body><div class=x1><ul><li>Home</li><li>Products</li><li>About us</li><li>Contact</li></ul></div>"
        "<table><tr><td><a href=/a>Ten ways to cook potatoes that your neighbours have never heard of</a></td><td><a href=/b>What the mayor said about the new market hall on Monday</a></td></tr></table>"
        f"<div class=x2><h2>The old bridge</h2>{''.join(f'<p>{p}</p>' for p in story)}</div>"
        "<div class=x3><div>Print</div><div>Back to top</div><div>Imprint</div><div>Terms</div><div>All rights reserved</div></div></body></html>"
    )
    assert html_extract.main_text(page) == "\n\n".join(["The old bridge", *story])
    assert html_extract.main_text("<p>hi</p>") == "hi"
    assert html_extract.main_text("<div><a name=top>  <a href=/h>Home</a></div><div><a href=/a>About</a></div>") == ""


def test_warc_round_trip(spark, odd_pages):
    for pages in (spark.read.parquet(f"{FOLDER}/pages.parquet"), odd_pages):
        rows = pages.select("page_id", "html").collect()
        last = {}
        for r in rows:
            if r.page_id is not None:
                last[r.html or ""] = max(r.page_id, last.get(r.html or "", r.page_id))
        want = Counter()
        for r in rows:
            data = (r.html or "").encode()
            refers = last.get(r.html or "") if r.page_id != last.get(r.html or "") else None
            want[r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers] += 1
        assert Counter(map(tuple, warc.round_trip(pages).collect())) == want


def test_decontamination_matches_brute_force(spark, documents, texts):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if w]
    windows = defaultdict(set)
    for r in items.collect():
        w = split(r.text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(r.item_id))
    sizes = {len(k) for k in windows}
    for r in decontam.find(documents, items, block_words=300).collect():
        w = split(texts[r.doc_id])
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (t := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[t]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_splits_items_as_documents(spark):
    spaces = "\u0085 \u00a0 \u2000 \u2009 \u2028 \u2029 \u202f \u3000".split(" ")
    passages = [f"Une{s}phrase courte" for s in spaces] + [" ".join(f"mot{k}" for k in range(6)) + f"{s}: " + " ".join(f"fin{k}" for k in range(5)) for s in spaces]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"avant cela {p} et la suite") for i, p in enumerate(passages)], "doc_id long, text string")
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]
    for r in decontam.find(docs, items).collect():
        assert (r.n_hit, r.n_items) == (len(split(passages[r.doc_id])), 1)
    assert {r.text for r in decontam.clean(docs, items, max_coverage=1.0).collect()} == {"avant cela   et la suite"}


def test_language_model(documents, texts):
    training = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i in texts}
    counts = Counter(w for i, t in texts.items() if training[i] for w in [*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    rows = lm_score.score(documents).collect()
    for r in rows:
        w = [*words(texts[r.doc_id]), "\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not training[r.doc_id], len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    seq = {i: ["\t", *words(t), "\n"] for i, t in texts.items()}
    hashed = {w: int(h) >> 60 for w, h in ((w, lm_score.hashes(pa.array([w]))[0]) for w in {x for q in seq.values() for x in q})}
    one = lambda w: (counts[w] + 0.5) / (n + 0.5 * (v + 1))
    two, three = defaultdict(Counter), defaultdict(Counter)
    for i, q in seq.items():
        if training[i]:
            for a, b in zip(q, q[1:]):
                two[a, hashed[b]][b] += 1
            for a, b, c in zip(q, q[1:], q[2:]):
                three[a, b][c] += 1
    share = [0.5 / 16 / (n + 0.5 * (v + 1))] * 16
    for w in counts:
        share[hashed[w]] += one(w)
    begins = Counter(q[0] for i, q in seq.items() if training[i])

    def second(a, b):
        s, of = hashed[b], two[a, hashed[b]]
        all_ = sum(of.values())
        inside = (max(of[b] - 0.75, 0) + 0.75 * len(of) * one(b) / share[s]) / all_ if all_ else one(b) / share[s]
        return (all_ + 16 * share[s]) / ((begins if a == "\t" else counts)[a] + 16) * inside

    def third(a, b, c):
        of = three[a, b]
        all_ = sum(of.values())
        return (max(of[c] - 0.75, 0) + 0.75 * len(of) * second(b, c)) / all_ if all_ else second(b, c)

    for r in rows:
        q = seq[r.doc_id]
        want = math.log10(second(q[0], q[1])) + sum(math.log10(third(*x)) for x in zip(q, q[1:], q[2:]))
        assert abs(r.score - want) <= 4 / lm_score.STEPS * r.n_tokens
    for a, b in (("\t", seq[min(seq)][1]), (seq[min(seq)][1], seq[min(seq)][2])):
        unknown = 1 - sum(third(a, b, c) for c in counts)
        assert 0 < unknown < 0.01
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_trie_searches_its_ranges():
    random = np.random.default_rng(3)
    for top in (5, 1000, 1 << 40):
        values = np.sort(random.integers(0, top, 3000).astype(np.uint64))
        packed = lm_score.EliasFano.packed(values)
        opened, end = lm_score.EliasFano.opened(np.frombuffer(packed, np.uint8), 0)
        assert end == len(packed) and (opened[np.arange(3000)] == values).all()
        wanted = random.integers(0, top, 500).astype(np.uint64)
        begin = random.integers(0, 3000, 500)
        stop = np.minimum(begin + random.integers(0, 900, 500), 3000)
        for w, b, e, at in zip(wanted, begin, stop, opened.find(wanted, begin, stop), strict=True):
            assert at == next((k for k in range(b, e) if values[k] == w), -1)
    node, other = np.uint64(7 << 28), np.uint64(9 << 28)
    pairs = np.array([node | np.uint64(3), node | np.uint64(5), other | np.uint64(3)], np.uint64)
    packed = lm_score.trie(pairs, np.array([4, 2, 1]), np.array([0, 0, 1]), np.array([8, 9, 8], np.uint64), np.array([3, 1, 2]), 7)
    with lm_score.Trie(packed) as opened:
        nodes, second, thirds = opened.codes(pairs, np.array([0, 0, 1, 1, 2]), np.array([8, 9, 8, 9, 8], np.uint64))
    got = lm_score.restored(thirds, 0.0)
    assert np.allclose(got, [2.25 / 4, 0.25 / 4, 1.25 / 2, 0, 0], rtol=1e-3)
    assert np.allclose(lm_score.restored(second[:, 0], 0.0), [3.25 / 6, 1.25 / 6, 0.25], rtol=1e-3)
    assert np.allclose(lm_score.restored(second[:, 1], 1.0), [1.5 / 4, 0.75 / 2, 1], rtol=1e-3)
    assert np.allclose(lm_score.restored(nodes, 0.0), [[1.5 / 6, 6 / 7], [0.75, 1 / 7]], rtol=1e-3)


def test_odd_rows(spark, odd, odd_pages):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "w1 w2 w3")], "item_id long, text string")
    n = odd.count()
    assert secret_scan.scan(odd).count() == near_dedup.groups(odd).count() == decontam.find(odd, items).count() == lm_score.score(odd).count() == quality.judge(odd, queries.QUALITY_MODELS, {}).count() == n
    assert url_filter.judge(odd_pages).count() == html_extract.extract(odd_pages).count() == odd_pages.count()
    out = line_dedup.dedup(odd)
    assert out.columns == odd.columns and out.count() == n
    assert {r.text for r in out.where("doc_id = 5").collect()} == {"same line of some words here"}
    components = {r.doc_id: r.component_id for r in near_dedup.groups(odd).collect()}
    assert components[2] == 2 and components[3] == 3 and components[5] == 5


def test_empty_tables(spark, odd, odd_pages):
    none, pages = odd.limit(0), odd_pages.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (line_dedup.dedup(none), secret_scan.scan(none), packing.pack(none, queries.TOKENIZER), near_dedup.groups(none), decontam.find(none, items), lm_score.score(none), quality.judge(none, queries.QUALITY_MODELS, {}), url_filter.judge(pages), html_extract.extract(pages), warc.round_trip(pages)):
        assert out.count() == 0


def test_pipeline_keeps_columns_and_rows(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == documents.columns, name
        assert 0 < out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), documents.schema)
    ids = {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert ids == {r.doc_id for r in docs.collect()}


def test_line_dedup_with_equal_ids_and_clashing_columns(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(0, b, 1), (1, a, 2), (1, b, 3), (2, None, 4), (3, f"{a}\n{b} more", 5)], "doc_id long, text string, __gone int")
    got = {(r.doc_id, r["__gone"]): r.text for r in line_dedup.dedup(docs).collect()}
    assert got == {(0, 1): b, (1, 2): a, (1, 3): "", (2, 4): None, (3, 5): ""}


def test_line_dedup_with_long_lists_only(spark, documents, texts, monkeypatch):
    direct = {tuple(r) for r in line_dedup.matches(documents).collect()}
    monkeypatch.setattr(line_dedup, "LONG", 2)
    monkeypatch.setattr(line_dedup, "WIDE", 4)
    assert {tuple(r) for r in line_dedup.matches(documents).collect()} == direct
