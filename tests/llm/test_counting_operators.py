"""Phrases, token files and the divergence audit against brute force, DuckDB and odd rows."""

import io
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestar.llm import divergence, id_files, phrases, queries

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (None, "one two. one two three", "en", "s", "x"), (1, None, None, None, None), (2, "", "en", "", "y"), (3, " \t\r\n ;;", "", "s", "z"),
    (4, "A b C\td e f Été İ x" * 3, "fr", "s", "q"), (5, "one two three\none two three" * 40, "en", "s", "q"), (5, "one two three\none two three" * 40, "en", "s", "q"),
    (6, " ".join(f"w{i % 50}" for i in range(30_000)), "en", "t", "q"), (7, "x" * 50_000, "en", "t", "q"), (8, "one one one one one one, one one", "en", "u", "q"), (9, "<|endoftext|> a<|endoftext|>b don't", "en", "u", "q"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, `a.b` string")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    return connection


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_phrases(docs, least, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            w = tuple(x for x in re.split("[ \t]+", piece) if x)
            n[lang] += len(w)
            f.update((lang, w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    found = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    covered = set()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            covered.update((lang, p[i : i + k]) for i in range(len(p) - k + 1) if 100 * a >= 80 * f[lang, p[i : i + k]])
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in covered:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])), key=repr)


def test_phrases_match_duckdb(documents, con):
    assert rows(phrases.mine(documents)) == sorted(con.execute(phrases.oracle_sql()).fetchall(), key=repr)


def test_phrases_with_hot_prefixes_and_many_ranges(documents, monkeypatch):
    """Below hot words and hot pairs ranges are split by the next word."""
    monkeypatch.setattr(phrases, "RANGE_WORDS", 1000)
    monkeypatch.setattr(phrases, "HOT_SHARE", 1e-4)
    want = brute_phrases([(r.text, r.lang) for r in documents.collect()], 5, 300)
    assert len(want) > 300 and rows(phrases.mine(documents, least=5, top=300)) == want


def test_phrases_on_odd_rows(odd):
    """Nulls, ties at the last rank, repeated rows, a word over and over, long texts and words."""
    want = brute_phrases([(r[1], r[2]) for r in ODD], 2, 7)
    assert ("und" not in {w[0] for w in want}) and rows(phrases.mine(odd, least=2, top=7)) == want


def test_tries_come_back_and_merge():
    rng = np.random.default_rng(1)
    runs, want = [], Counter()
    for _ in range(5):
        found = np.unique(rng.integers(1, 9, (200, 3)) * (1 << 60) // 10, axis=0)
        n = rng.integers(1, 70_000, len(found))
        data = phrases.serialised(list(found.T.copy()), n)
        columns, count = phrases.paths(data, 3)
        assert [tuple(x) for x in zip(*columns)] == [tuple(x) for x in found] and count.tolist() == n.tolist()
        runs.append((columns, count))
        want.update({tuple(p): int(k) for p, k in zip(found.tolist(), n)})
    columns, count = phrases.merged(runs)
    assert [*zip(zip(*(c.tolist() for c in columns)), count.tolist())] == sorted(want.items())


def brute_files(pairs, tokenizer):
    out, at = [], 0
    for i, text in sorted(pairs, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0)):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_match_the_library(documents, odd, bits):
    tokenizer = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    for df in (documents, odd):
        assert rows(id_files.round_trip(df, queries.BYTE_TOKENIZER, bits=bits)) == brute_files([(r.doc_id, r.text) for r in df.collect()], tokenizer)


def test_token_files_roll_over_and_keep_ids(spark, documents, tmp_path, monkeypatch):
    """Several files a task and blocks smaller than documents; ids come back whole."""
    monkeypatch.setattr(id_files, "SLICE_BYTES", 20_000)
    folder = f"file://{tmp_path}/ids"
    manifest = spark.createDataFrame(id_files.write(documents, folder, queries.BYTE_TOKENIZER, file_ids=5000, block_ids=64).collect(), "name string, part long, file long, docs long, ids long")
    assert manifest.count() > 5 and manifest.agg({"docs": "sum"}).first()[0] == documents.count()
    tokenizer = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    got = {r.doc_id: r.ids for r in id_files.read(spark, folder, manifest, with_ids=True).collect()}
    assert got == {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [2] for r in documents.collect()}


@pytest.mark.parametrize("bits", [False, True])
def test_blocks_are_read_by_index(bits):
    ids = np.random.default_rng(2).integers(0, [1 << 32, 3, 50_000, 70_000] * 250, 1000).astype(np.uint32)
    out = io.BytesIO()
    writer = id_files.IdWriter(out, pa.string(), bits, block_ids=100)
    for k in range(0, 1000, 250):
        writer.add(pa.array([f"d{k}"]), np.array([250]), ids[k : k + 250])
    writer.close()
    reader = id_files.IdReader(out.getvalue())
    assert len(reader.at) == 10 and [x.tolist() for x in reader.each()] == ids.reshape(4, 250).tolist()
    for a, b in ((0, 0), (0, 1), (99, 101), (250, 990), (999, 5000), (1000, 1001)):
        assert reader.read(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        id_files.IdReader(b"nothing of this kind" * 9)


def test_parts_never_change_ids():
    tokenizer, encoder = Tokenizer.from_file(queries.BYTE_TOKENIZER), id_files.PartEncoder(queries.BYTE_TOKENIZER, cache_parts=50)
    rng = np.random.default_rng(3)
    bits = ["a", "B", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "　", " ", "é", "…", "'s", "'", "n't", ",", ".", "|", "<|endoftext|>", "<|", "9", "中", "́", "İ", "_", "\U0001f600", "don't"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(3000)]
    n, ids = encoder(pa.array(texts, pa.large_string()), 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def brute_audit(docs, least):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        found = term.findall(lowered(text))
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    share = lambda c, n, v: 1 + 1_000_000_000 * (c + 2) // (n + 2 * v)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole, v = sum((counts[lang, s] for s in sources), Counter()), len(kept)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], n[s], v) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(n.values()), v) for t in kept}
        for s in sources:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode()) for o in sources - {s})
            terms = sorted((-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "pair", o.decode(), -f, i + 1) for i, (f, o) in enumerate(pairs)] + [(lang, s, "term", t.decode(), -f, i + 1) for i, (f, t) in enumerate(terms[:10])]
    return sorted(out, key=repr)


def test_audit_matches_duckdb_and_brute_force(documents, con):
    want = brute_audit([(r.text, r.lang, r.source) for r in documents.collect()], 10)
    assert rows(divergence.audit(documents)) == want == sorted(con.execute(divergence.oracle_sql()).fetchall(), key=repr)


def test_audit_over_many_tiles_and_slabs(documents, odd, monkeypatch):
    for name, value in (("CHUNK", 16), ("SLAB", 2), ("BLOCK", 3), ("SENT_ROWS", 0)):
        monkeypatch.setattr(divergence, name, value)
    for df, least in ((documents, 10), (odd, 1), (odd, 2)):
        assert rows(divergence.audit(df, least_docs=least)) == brute_audit([(r.text, r.lang, r.source) for r in df.collect()], least)


def test_shares_are_exact_beyond_64_bits():
    count, total, terms = np.array([0, 1, 10**14, 9 * 10**14]), 9 * 10**14, 7 * 10**6
    assert divergence.shares(count, total, terms).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in count]


def test_empty_tables(odd):
    none = odd.where("false")
    assert rows(phrases.mine(none)) == rows(divergence.audit(none)) == rows(id_files.round_trip(none, queries.BYTE_TOKENIZER)) == []
