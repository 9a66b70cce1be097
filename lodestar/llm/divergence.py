"""How far the sources of a language are from each other, and which terms set each of them apart.

Tasks count the terms of each (language, source) group over whole texts. The terms that a language keeps are dealt
to chunks of its vocabulary, where each has a position, so a group's counts in a chunk are one packed vector. The
groups of a language fall in blocks; every pair of blocks is a tile, and the vectors are replicated to the tiles of
their block. A task takes a tile and a slab of successive chunks and adds up its submatrix of pairs chunk by chunk;
submatrices of one tile add up over the slabs. So no task holds more than two blocks of vectors of one slab, however
large the vocabulary, the texts or the number of groups.

Smoothed shares are p = 1 + floor(10^9 (count + 2) / (N + 2 V)), with N the group's occurrences of kept terms and V
the number of kept terms; the distance of two shares is floor((p - q)^2 / (p + q)). All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Runs, as_array, byte_kinds, saved, sent_if_small, slices

#: Documents of its language that a term needs, and terms reported for a group.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Share units in a whole, and what smoothing adds to a count.
UNIT, ADDED = 1_000_000_000, 2
#: Terms in a chunk of the vocabulary, chunks in a slab, groups in a block; all but for chance, as hashes deal them.
CHUNK, SLAB, BLOCK = 4096, 8, 16
#: Bytes of text counted at once, and rows of a dimension that are sent to all tasks at most.
SLICE_BYTES, SENT_ROWS = 8 << 20, 100_000
#: Terms are runs of letters: of A-Z, a-z and all characters beyond ASCII.
KINDS = byte_kinds("".join(chr(c) for c in range(128) if not chr(c).isalpha()))


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group; null is the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SLICE_BYTES):
                words = Runs(as_array(batch.column("t")), KINDS)
                if not len(words.codes):
                    continue
                lang, source = (batch.column(c).dictionary_encode() for c in ("l", "s"))
                l, s = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lang, source))
                group = (l * len(source.dictionary) + s)[words.rows()]
                terms, rows = len(words.vocabulary), batch.num_rows
                # One sort tells occurrences and documents: ordered by group, term and row.
                key = np.sort((group * terms + words.codes) * rows + words.rows())
                new_pair = np.concatenate([[True], key[1:] != key[:-1]])
                term_of = key // rows
                new_term = np.concatenate([[True], term_of[1:] != term_of[:-1]])
                at = np.flatnonzero(new_term)
                found = term_of[at]
                of, term = found // terms, found % terms
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(of // len(source.dictionary))).cast(pa.string()), source.dictionary.take(pa.array(of % len(source.dictionary))).cast(pa.string()),
                        words.vocabulary.take(pa.array(term)).cast(pa.string()), pa.array(np.diff(at, append=len(key))), pa.array(np.add.reduceat(new_pair.astype(np.int64), at)),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    own = docs.select(F.col(text_col).alias("t"), _name(lang_col).alias("l"), _name(source_col).alias("s"))
    return own.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share; the product may pass 64 bits."""
    whole = F.lit(UNIT).cast("decimal(10,0)") * (count + ADDED).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", whole, (total + terms * 2).cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The smoothed shares of counts, by long division so that no product passes 64 bits."""
    divisor = np.int64(total + ADDED * terms)
    quotient, rest = np.divmod(count + ADDED, divisor)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, divisor)
        quotient = quotient * 1000 + step
    return quotient + 1


def _dense(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[-1]}", (len(packed) - 1) // packed[-1]).astype(np.int64)


def vectors(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, chunk, packed): the counts of a group in a chunk of its language's kept terms, in the fewest bytes a count."""
    chunks = F.ceil(F.col("terms") / CHUNK)
    placed = kept.join(langs.select("lang", "terms"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), chunks).cast("int"))
    placed = placed.withColumn("pos", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    lists = placed.groupBy("lang", "chunk", "source").agg(F.collect_list("pos").alias("pos"), F.collect_list("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for pos, n in zip(batch.column("pos"), batch.column("n"), strict=True):
                pos, n = (x.values.to_numpy(zero_copy_only=False) for x in (pos, n))
                width = next(w for w in (1, 2, 4, 8) if w == 8 or int(n.max()) < 1 << 8 * w)
                dense = np.zeros(int(pos.max()) + 1, f"<u{width}")
                dense[pos] = n
                packed.append(dense.tobytes() + bytes([width]))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), batch.column("chunk"), pa.array(packed, pa.binary())], names=["lang", "source", "chunk", "packed"])

    return lists.mapInArrow(run, "lang string, source string, chunk int, packed binary")


def tile(table: pa.Table) -> pa.Table:
    """The submatrix of one tile over one slab: (lang, a, b, part, used) for each pair of its groups.

    Rows without a vector name the groups of the tile, so that a group without a count in the slab takes part.
    part adds up terms that any group of the tile has; used is their number, and the others differ by a constant.
    """
    lang, bi, bj = (table.column(c)[0].as_py() for c in ("lang", "bi", "bj"))
    head = table.filter(table.column("packed").is_null())
    groups = sorted({(b, s, n, v) for b, s, n, v in zip(*(head.column(c).to_pylist() for c in ("block", "source", "total", "terms")), strict=True)})
    left = [g for g in groups if g[0] == bi]
    right = left if bi == bj else [g for g in groups if g[0] == bj]
    place = {(g[0], g[1]): i for i, g in enumerate(groups)}
    sums, used = np.zeros((len(groups), len(groups)), np.int64), 0
    body = table.filter(table.column("packed").is_valid()).sort_by("chunk")
    numbers = body.column("chunk").to_numpy()
    for at in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1) if len(numbers) else []:
        rows = body.slice(int(at[0]), len(at))
        found = [(place[b, s], _dense(p)) for b, s, p in zip(*(rows.column(c).to_pylist() for c in ("block", "source", "packed")), strict=True)]
        matrix = np.zeros((len(groups), max(len(v) for _, v in found)), np.int64)
        for i, v in found:
            matrix[i, : len(v)] = v
        matrix = matrix[:, matrix.any(axis=0)]
        used += matrix.shape[1]
        share = np.stack([shares(m, g[2], g[3]) for m, g in zip(matrix, groups, strict=True)])
        others = share[[place[g[0], g[1]] for g in right]]
        for k, g in enumerate(left):
            q = others[k + 1 :] if bi == bj else others
            p = share[place[g[0], g[1]]]
            apart = (p - q) * (p - q) // (p + q)
            sums[place[g[0], g[1]], [place[r[0], r[1]] for r in (right[k + 1 :] if bi == bj else right)]] += apart.sum(axis=1)
    pairs = [(x[1], y[1], int(sums[place[x[0], x[1]], place[y[0], y[1]]])) for k, x in enumerate(left) for y in (right[k + 1 :] if bi == bj else right)]
    a, b, part = zip(*pairs, strict=True) if pairs else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "part": pa.array(part, pa.int64()), "used": pa.array([used] * len(a), pa.int64())})


def pair_sums(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of every two groups of a language over all its kept terms."""
    blocks = F.col("blocks")
    sized = groups.join(F.broadcast(langs) if langs.count() <= SENT_ROWS else langs, "lang").withColumn("blocks", F.ceil(F.col("groups") / BLOCK).cast("int"))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("source"), blocks).cast("int"))
    slabs = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("terms") / CHUNK) / SLAB)).cast("int")
    head = sized.withColumn("slab", F.explode(F.sequence(F.lit(0), slabs - 1))).withColumns({"chunk": F.lit(None).cast("int"), "packed": F.lit(None).cast("binary")})
    body = vectors(kept, langs).join(sent_if_small(sized, SENT_ROWS), ["lang", "source"]).withColumn("slab", F.floor(F.col("chunk") / SLAB).cast("int"))
    columns = ["lang", "slab", "block", "blocks", "source", "total", "terms", "chunk", "packed"]
    tiles = head.select(columns).unionByName(body.select(columns)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = tiles.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other", "blocks")
    parts = tiles.groupBy("lang", "bi", "bj", "slab").applyInArrow(tile, "lang string, a string, b string, part long, used long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("used").alias("used"))
    none = groups.join(langs.select("lang", "terms"), "lang").select("lang", "source", F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(1).alias("zero"), "terms")
    none = sent_if_small(none, SENT_ROWS)
    x, y = (none.select("lang", F.col("source").alias(c), F.col("zero").alias(f"zero_{c}"), *(["terms"] if c == "a" else [])) for c in ("a", "b"))
    whole = sums.join(x, ["lang", "a"]).join(y, ["lang", "b"])
    value = F.col("part") + (F.col("terms") - F.col("used")) * _apart(F.col("zero_a"), F.col("zero_b"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return whole.select("lang", value.alias("value"), both.alias("pair")).select("lang", "pair.source", "pair.item", "value")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group: its distance to every other source of its language
    (part pair), and the terms it has more of than its language (part term, the first top_terms).

    A null text, lang or source is the empty string. A group without terms takes part with counts of 0, and where a
    language keeps no term all distances are 0; repeated rows count as documents each; an empty table gives no rows.
    """
    over = Window.partitionBy("lang", "term")
    counted = counts(docs, text_col, lang_col, source_col)
    counted = counted.withColumns({"in_docs": F.sum("docs").over(over), "in_lang": F.sum("n").over(over), "first": F.col("source") == F.min("source").over(over)})
    kept = saved(counted.where(F.col("in_docs") >= least_docs).drop("docs", "in_docs"), "kept")
    names = docs.select(_name(lang_col).alias("lang"), _name(source_col).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = saved(names.join(totals, ["lang", "source"], "left").fillna(0, ["total"]), "groups")
    sizes = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
    langs = saved(groups.groupBy("lang").agg(F.count("*").alias("groups")).join(sizes, "lang", "left").fillna(0, ["terms", "lang_total"]), "langs")
    sized = groups.join(langs.select("lang", "terms", "lang_total"), "lang")
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    own = kept.join(sent_if_small(sized, SENT_ROWS), ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    pairs = pair_sums(kept, groups, langs).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return own.unionByName(pairs.withColumn("rank", F.row_number().over(order)))


def oracle_sql() -> str:
    """DuckDB SQL for audit() with its default parameters."""
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    share = "1 + (1000000000::HUGEINT * ({} + 2)) // ({} + 2 * {})"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS no FROM documents),
words AS (SELECT no, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
terms AS (SELECT lang, term, count(*) AS in_lang FROM words GROUP BY lang, term HAVING count(DISTINCT no) >= {LEAST_DOCS}),
own AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN terms USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(in_lang) AS n FROM terms GROUP BY lang),
grps AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(sum(o.n), 0) AS n, coalesce(any_value(l.n), 0) AS ln
  FROM grps g LEFT JOIN langs l ON l.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source GROUP BY g.lang, g.source, v),
full_grid AS (SELECT t.lang, t.source, k.term, coalesce(o.n, 0) AS cnt, {share.format("coalesce(o.n, 0)", "t.n", "t.v")} AS p, {share.format("k.in_lang", "t.ln", "t.v")} AS q
  FROM totals t JOIN terms k ON k.lang = t.lang LEFT JOIN own o ON o.lang = t.lang AND o.source = t.source AND o.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM full_grid a JOIN full_grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM full_grid WHERE cnt > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
