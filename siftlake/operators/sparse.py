"""Sparse (lexical) vectors: terms, weights, search."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.scratch import PART, Scratch, dealt, written

#: Words that carry no meaning of their own.
STOPWORDS = "a an and are as at be by for from has he in is it its of on or that the this to was with you".split()
#: The usual constants of BM25, features that a chunk keeps, and the least length of a term.
K1, B, FEATURES, LEAST_LENGTH = 1.2, 0.75, 128, 2
#: Postings of a group of documents, about; groups that a search scores before it knows what can still be among the best;
#: shelves, each for documents whose heaviest weight is half as heavy as the shelf's before.
GROUP, FIRST, SHELVES = 1 << 15, 2, 40
#: Postings of a task that finds blocks' largest weights, about.
TASK = 1 << 19
#: Documents that a task scores with a tenant's queries, about.
BLOCK = 8192
#: Sums in another order differ by less; a group within this of the k-th score is read.
SLACK = 1e-8


def cut(text: Column) -> Column:
    """Runs of letters and their marks, in lower case, empty ones and stop words among them."""
    return F.split(F.lower(text), r"[^\p{L}\p{M}]+")


def term_counts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, term and tf: how often each term, a run of letters and their marks in any script, stop words apart, stands in the row's text.

    Texts are dealt by their keys before they are cut: counts and sums of a text then need no shuffle of its terms."""
    found = cut(F.col(text))
    # Filtered after the explode: that stays in generated code, a lambda over the array would not.
    rows = dealt(docs.select(*keys, text), *keys, text=text).select(*keys, F.explode(found).alias("term")).filter((F.col("term") != "") & ~F.col("term").isin(STOPWORDS))
    return rows.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def l1_weights(weighted: DataFrame, keys: list[str], weight: str = "w") -> DataFrame:
    """keys, term, weight: sums of positive weights by term, divided by their sum in the row."""
    sums = weighted.filter(F.col(weight) > 0).groupBy(*keys, "term").agg(F.sum(weight).alias("s"))
    return sums.withColumn("weight", F.col("s") / F.sum("s").over(Window.partitionBy(*keys))).drop("s")


def count_weights(counts: DataFrame, keys: list[str]) -> DataFrame:
    """l1_weights of term_counts, each of whose rows has a term of its own."""
    return counts.select(*keys, "term", (F.col("tf") / F.sum("tf").over(Window.partitionBy(*keys))).alias("weight"))


def last_of_equal(terms: DataFrame, keys: list[str], order: str, term_id: str) -> DataFrame:
    """Of terms of a row that share an id, the last in order stays: weights are not summed."""
    latest = F.row_number().over(Window.partitionBy(*keys, term_id).orderBy(F.desc(order)))
    return terms.withColumn("_n", latest).filter("_n = 1").drop("_n")


def idf(n_docs: Column, with_term: Column) -> Column:
    return F.log((n_docs - with_term + 0.5) / (with_term + 0.5) + 1)


def sparse_topk(queries: DataFrame, postings: DataFrame, n_docs: DataFrame, k: int, tenant: str = "site_id", doc: str = "doc_id", digits: int = 9) -> DataFrame:
    """The k chunks with the largest sum of query weight x idf x chunk weight in each query's tenant.

    queries: query_id, tenant, term, qw. postings: tenant, doc, term, dw. n_docs: tenant, n. Only terms of queries are
    kept before anything is joined; ties go to the smaller id.
    """
    wanted = queries.select(tenant, "term").distinct()
    hits = postings.join(wanted, [tenant, "term"], "left_semi")
    spread = hits.groupBy(tenant, "term").agg(F.count("*").alias("_df")).join(n_docs, tenant).select(tenant, "term", idf(F.col("n"), F.col("_df")).alias("_idf"))
    scored = hits.join(spread, [tenant, "term"]).join(queries, [tenant, "term"]).groupBy("query_id", tenant, doc).agg(F.sum(F.col("qw") * F.col("_idf") * F.col("dw")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", tenant).orderBy(F.desc(F.round("score", digits)), doc))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def packed_weights(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, terms, weights: count_weights as one row for each text, with parallel arrays."""
    rows = counts.groupBy(*keys).agg(F.collect_list(F.struct("term", "tf")).alias("_held"), F.sum("tf").alias("_all"))
    return rows.select(*keys, F.col("_held.term").alias("terms"), F.transform("_held.tf", lambda x: x / F.col("_all")).alias("weights"))


def blocked_topk(queries: DataFrame, docs: DataFrame, n_docs: DataFrame, k: int, tenant: str = "site_id", doc: str = "doc_id", digits: int = 9, block: int = BLOCK) -> DataFrame:
    """The rows of sparse_topk, for many queries with many terms, whose sums for all pairs are too many rows to be sent.

    queries: query_id, tenant, terms, weights; without a tenant they are asked of each tenant that has a term of theirs. docs: tenant,
    doc, terms, weights, a written table; both parallel arrays.
    A tenant's documents are dealt to blocks of about `block` rows, and its queries go to each of them: a task scores all
    queries against a block, and a block sends k rows for a query. So what is sent grows with the documents, and with
    the queries times a tenant's blocks.
    """
    own = [tenant] if tenant in queries.columns else []
    asked = queries.select("query_id", *own, F.explode(F.arrays_zip("terms", "weights")).alias("_t")).select("query_id", *own, F.col("_t.terms").alias("term"), F.col("_t.weights").alias("qw"))
    spread = docs.select(tenant, F.explode("terms").alias("term")).groupBy(tenant, "term").agg(F.count("*").alias("_df"))
    asked = asked.join(spread, [*own, "term"]).join(n_docs.select(tenant, "n"), tenant).select("query_id", tenant, "term", (F.col("qw") * idf(F.col("n"), F.col("_df"))).alias("w"))
    asked = written(asked.groupBy("query_id", tenant).agg(F.collect_list(F.struct("term", "w")).alias("_held")), "asked")
    blocks = written(docs.groupBy(tenant).agg((F.floor(F.count("*") / block) + 1).cast("int").alias("_blocks")), "blocks")
    left = asked.join(blocks, tenant).select(tenant, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "query_id", F.col("_held.term").alias("terms"), F.col("_held.w").alias("weights"))
    # Tenants without a query are left out; the other side has no more rows than there are tenants.
    right = docs.join(blocks.join(asked.select(tenant).distinct(), tenant, "left_semi"), tenant).select(tenant, F.pmod(F.xxhash64(doc), F.col("_blocks")).cast("int").alias("_block"), doc, "terms", "weights")

    def within(key: tuple, q: pa.Table, v: pa.Table) -> pa.Table:
        found = ([], [], [])
        if q.num_rows and v.num_rows:
            ids = v.column(doc).fill_null(np.iinfo(np.int64).max).to_numpy()  # a document without a number is the last of equals
            wanted, ends = _flat(q, "terms")
            known = wanted.unique()
            code, factors = pc.index_in(wanted, known).to_numpy(), _flat(q, "weights")[0].to_numpy()
            held, sizes = _flat(v, "terms")
            own = pc.index_in(held, known).fill_null(-1).to_numpy()
            order = np.argsort(own, kind="stable")[np.count_nonzero(own < 0) :]
            row = np.repeat(np.arange(len(ids)), np.diff(sizes))[order]
            dw = _flat(v, "weights")[0].to_numpy()[order]
            first = np.searchsorted(own[order], np.arange(len(known) + 1))
            for number, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                begin, size = first[code[a:b]], first[code[a:b] + 1] - first[code[a:b]]
                at = np.arange(size.sum()) + np.repeat(begin - (size.cumsum() - size), size)
                score = np.bincount(row[at], dw[at] * np.repeat(factors[a:b], size), len(ids))
                hit = np.zeros(len(ids), bool)
                hit[row[at]] = True
                some = np.flatnonzero(hit)
                if len(some):
                    shown = np.round(score[some], digits)
                    near = shown >= np.partition(shown, len(some) - k)[len(some) - k] if len(some) > k else np.ones(len(some), bool)
                    best = some[near][np.lexsort((ids[some[near]], -shown[near]))[:k]]
                    found[0].append(np.full(len(best), number))
                    found[1].append(best)
                    found[2].append(score[best])
        columns = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(found, (np.int64, np.int64, np.float64), strict=True)]
        site = pa.array([key[0].as_py()] * len(columns[0]), q.schema.field(tenant).type)
        return pa.table([site, q.column("query_id").take(pa.array(columns[0])), v.column(doc).take(pa.array(columns[1])), pa.array(columns[2])], names=[tenant, "query_id", doc, "score"])

    scored = left.groupBy(tenant, "_block").cogroup(right.groupBy(tenant, "_block")).applyInArrow(within, f"`{tenant}` {dict(docs.dtypes)[tenant]}, query_id long, `{doc}` long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", tenant).orderBy(F.desc(F.round("score", digits)), F.asc_nulls_last(doc)))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _flat(rows: pa.Table, column: str) -> tuple[pa.Array, np.ndarray]:
    """The elements of a column of arrays, and where each row's begin; the last number is their end."""
    lists = rows.column(column).combine_chunks()
    return pc.list_flatten(lists), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])


@dataclass
class SparseIndex:
    """What a sparse search reads: postings (shelf, tenant, doc, term, dw), a folder for each shelf; tops (tenant, term, shelf,
    part, top, n), the largest weight and the number of postings of a term in each group; parts (tenant, shelf, parts), how
    many groups a shelf has; sizes (tenant, n). All are written tables."""

    postings: DataFrame
    tops: DataFrame
    parts: DataFrame
    sizes: DataFrame
    tenant: str
    doc: str

    def placed(self) -> DataFrame:
        """The postings with their group: shelf and part."""
        return self.postings.join(self.parts, [self.tenant, "shelf"]).withColumn("part", F.pmod(F.xxhash64(self.doc), "parts")).drop("parts")


def sparse_index(postings: DataFrame, sizes: DataFrame, tenant: str = "site_id", doc: str = "doc_id", group: int = GROUP) -> SparseIndex:
    """An index of postings (tenant, doc, term, dw) for block-max search. sizes: tenant, n (its documents).

    Documents are ordered by impact: a shelf has those whose heaviest weight lies between two powers of two, dealt to groups of
    about `group` postings. A term's postings in a group are a block, known by its largest weight. A shelf is numbered
    within all tenants, so the tables of shelves and parts grow with tenants alone. Groups are dealt to tasks of about TASK
    postings before their blocks are summed up: few postings of a file share a block, so a task that did that for a file
    would hold nearly all of them.
    """
    heaviest = F.max("dw").over(Window.partitionBy(tenant, doc))
    shelf = F.least(F.greatest(F.floor(-F.log2(heaviest)), F.lit(0)), F.lit(SHELVES - 1)).cast("int")
    rows = Scratch(postings.select(tenant, doc, "term", "dw", shelf.alias("shelf")), "postings", "shelf").df
    parts = written(rows.groupBy(tenant, "shelf").agg(F.ceil(F.count("*") / group).alias("parts")), "parts")
    index = SparseIndex(rows, rows, parts, written(sizes.select(tenant, "n"), "sizes"), tenant, doc)
    tasks = (parts.agg(F.sum("parts")).first()[0] or 0) * group // TASK
    placed = dealt(index.placed().select(tenant, "term", "shelf", "part", "dw"), tenant, "shelf", "part", least=tasks)
    index.tops = written(placed.groupBy(tenant, "term", "shelf", "part").agg(F.max("dw").alias("top"), F.count("*").alias("n")), "tops")
    return index


@dataclass
class SparseSearch:
    """A search's rows, and which groups it read for which query: first those with the largest bounds, then what could still
    change the result."""

    found: DataFrame
    bounds: DataFrame
    first: DataFrame
    rest: DataFrame
    shelves: list[int]


def indexed_search(queries: DataFrame, index: SparseIndex, k: int, digits: int = 9, first: int = FIRST) -> SparseSearch:
    """The rows of sparse_topk for queries (query_id, tenant, term, qw), reading only groups that can matter. Queries without a
    tenant are asked of each tenant that has a term of theirs.

    A group's bound is the sum of the query's weights times the blocks' largest weights. The groups with the largest bounds
    are scored first; the k-th score they give is one that others must reach, so a group with a smaller bound is never
    scored, and a shelf without a group left is not read. A query with fewer than k results so far leaves out nothing.
    """
    tenant, doc = index.tenant, index.doc
    key, group = ["query_id", tenant], [tenant, "shelf", "part"]
    hits = index.tops.join(queries, [tenant, "term"] if tenant in queries.columns else ["term"])
    df = F.sum("n").over(Window.partitionBy(*key, "term"))
    hits = hits.withColumn("df", df).join(index.sizes.withColumnRenamed("n", "_n"), tenant)
    hits = written(hits.select("query_id", *group, "term", "top", (F.col("qw") * idf(F.col("_n"), F.col("df"))).alias("w")), "hits")
    # Written, since its size, which doesn't grow with the groups, lets it be broadcast to the postings.
    weighted = written(hits.select(*key, "term", "w").distinct(), "weighted")
    bounds = hits.groupBy("query_id", *group).agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
    order = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("bound"), "shelf", "part"))
    bounds = written(bounds.withColumn("place", order), "bounds")
    begun = bounds.filter(F.col("place") <= first)

    def shelves_of(groups: DataFrame) -> list[int]:
        return sorted(r.shelf for r in groups.select("shelf").distinct().collect())  # SHELVES at most

    def scored(groups: DataFrame, shelves: list[int]) -> DataFrame:
        rows = index.placed().filter(F.col("shelf").isin(shelves)).join(weighted, [tenant, "term"])
        rows = rows.join(groups.select("query_id", *group), ["query_id", *group], "left_semi")
        return rows.groupBy(*key, doc).agg(F.sum(F.col("w") * F.col("dw")).alias("score"))

    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.round("score", digits)), doc))
    one = written(scored(begun, shelves_of(begun)), "scored")
    reach = one.withColumn("rank", rank).filter(F.col("rank") == k).select(*key, F.col("score").alias("reach"))
    rest = bounds.filter(F.col("place") > first).join(reach, key, "left").filter(F.col("reach").isNull() | (F.col("bound") + SLACK >= F.col("reach")))
    rest = written(rest, "rest")
    left = shelves_of(rest)
    both = one.unionByName(scored(rest, left)) if left else one
    return SparseSearch(both.withColumn("rank", rank).filter(F.col("rank") <= k), bounds, begun, rest, left)


def bm25_weights(counts: DataFrame, tenant: str, doc: str, most: int = FEATURES) -> DataFrame:
    """tenant, doc, term, weight of the `most` heaviest terms of each document, BM25 weights that sum to 1. Weights become decimals
    of nine digits before they are summed, so that the order of a sum doesn't matter."""
    text = Window.partitionBy(tenant, doc)
    sized = counts.filter(F.length("term") >= LEAST_LENGTH).withColumn("len", F.sum("tf").over(text)).withColumn("_one", (F.min("term").over(text) == F.col("term")).cast("long"))
    sized = written(sized, "sized")
    mean = sized.groupBy(tenant).agg((F.sum("tf") / F.sum("_one")).alias("avg_len"), F.sum("_one").alias("n"))
    spread = sized.groupBy(tenant, "term").agg(F.count("*").alias("df"))
    joined = sized.join(mean, tenant).join(spread, [tenant, "term"])
    w = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    rank = F.row_number().over(text.orderBy(F.desc("w"), "term"))
    kept = joined.select(tenant, doc, "term", F.round(w, 9).cast("decimal(18,9)").alias("w")).withColumn("_n", rank).filter(F.col("_n") <= most)
    return kept.select(tenant, doc, "term", (F.col("w").cast("double") / F.sum("w").over(text).cast("double")).alias("weight"))


def blocked_bm25(docs: DataFrame, tenant: str = "site_id", doc: str = "doc_id", text: str = "text", most: int = FEATURES, block: int = PART) -> DataFrame:
    """bm25_weights of the term_counts of docs, as one row for each document that has terms: tenant, doc, terms, weights, heaviest
    first.

    A tenant's texts are dealt to blocks of about `block` bytes. A block has a list of its terms, and its documents hold places in that
    list: only texts, lists and places are sent, and a term goes to its tenant's count and back once for a block, not once
    for a document.
    """
    blocks = written(docs.groupBy(tenant).agg((F.floor(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) / block) + 1).cast("int").alias("_blocks")), "blocks")
    tasks = blocks.agg(F.sum("_blocks")).first()[0] or 0
    rows = docs.filter(F.col(text).isNotNull()).join(blocks, tenant).select(tenant, F.pmod(F.xxhash64(doc), F.col("_blocks")).cast("int").alias("_block"), doc, text)
    rows = dealt(rows, tenant, "_block", least=tasks).select(tenant, "_block", doc, cut(F.col(text)).alias("_words"))
    kinds = dict(docs.dtypes)

    def encoded(key: tuple, rows: pa.Table) -> pa.Table:
        """A row with the block's terms, in order, and the number of documents that have each; a row for each document."""
        names = rows.column(doc).combine_chunks().dictionary_encode("encode")
        words, ends = _flat(rows, "_words")
        words = words.dictionary_encode()
        listed = words.dictionary.take(pc.array_sort_indices(words.dictionary))
        terms = listed.filter(pc.and_(pc.greater_equal(pc.utf8_length(listed), LEAST_LENGTH), pc.invert(pc.is_in(listed, pa.array(STOPWORDS)))))
        code = pc.index_in(words.dictionary, terms).fill_null(-1).to_numpy()[words.indices.to_numpy()]
        row = np.repeat(names.indices.to_numpy(), np.diff(ends))
        cells, tf = np.unique(row[code >= 0] * np.int64(max(len(terms), 1)) + code[code >= 0], return_counts=True)
        row, code = np.divmod(cells, max(len(terms), 1))
        some, first = np.unique(row, return_index=True)
        ends = np.append(first, len(row))
        size = pa.array(np.append(0, np.bincount(row, tf)[some].astype(np.int64) if len(some) else []), pa.int64())
        lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
        held = pa.nulls(1, rows.schema.field(doc).type)
        return pa.table({
            "list": pa.array([True] + [False] * len(some)), tenant: pa.array([key[0].as_py()] * (1 + len(some)), rows.schema.field(tenant).type), "_block": pa.array([key[1].as_py()] * (1 + len(some)), pa.int32()),
            doc: pa.chunked_array([held, names.dictionary.take(pa.array(some))]), "size": size,
            "terms": pa.ListArray.from_arrays(pa.array([0] + [len(terms)] * (1 + len(some)), pa.int32()), terms),
            "codes": lists(code, np.append(0, ends)), "counts": lists(np.append(np.bincount(code, minlength=len(terms)), tf), np.append(0, ends + len(terms))),
        })

    schema = f"list boolean, `{tenant}` {kinds[tenant]}, _block int, `{doc}` {kinds[doc]}, size long, terms array<string>, codes array<int>, counts array<int>"
    held = Scratch(rows.groupBy(tenant, "_block").applyInArrow(encoded, schema), "encoded", "list").df
    texts = held.filter(~F.col("list")).select(tenant, "_block", doc, "size", "codes", "counts")
    words = held.filter("list").select(tenant, "_block", F.explode(F.arrays_zip("terms", "counts")).alias("_w")).select(tenant, "_block", F.col("_w.terms").alias("term"), F.col("_w.counts").alias("df"))
    mean = written(texts.groupBy(tenant).agg((F.sum("size") / F.count("*")).alias("avg_len"), F.count("*").alias("n")), "mean")
    words = words.withColumn("df", F.sum("df").over(Window.partitionBy(tenant, "term"))).join(mean, tenant).select(tenant, "_block", "term", idf(F.col("n"), F.col("df")).alias("idf"))
    texts = texts.join(mean, tenant).select(*[F.col(c).alias(c) for c in (tenant, "_block", doc, "size", "avg_len", "codes", "counts")])  # the two sides come from one table

    def weighed(key: tuple, t: pa.Table, w: pa.Table) -> pa.Table:
        listed = w.column("term").combine_chunks()
        order = pc.array_sort_indices(listed)
        terms, by_code = listed.take(order), w.column("idf").to_numpy()[order.to_numpy()]
        codes, ends = _flat(t, "codes")
        codes, tf = codes.to_numpy(), _flat(t, "counts")[0].to_numpy().astype(np.float64)
        row = np.repeat(np.arange(t.num_rows), np.diff(ends))
        size, mean = t.column("size").to_numpy()[row], t.column("avg_len").to_numpy()[row]
        nines = _nines(by_code[codes] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)))
        order = np.lexsort((codes, -nines, row))
        order = order[np.arange(len(row)) - ends[row] < most]
        row, nines = row[order], nines[order]
        total = np.zeros(t.num_rows, np.int64)
        np.add.at(total, row, nines)
        ends = pa.array(np.append(0, np.bincount(row, minlength=t.num_rows).cumsum()), pa.int32())
        weights = (nines / 1e9) / (total / 1e9)[row]
        lists = [pa.ListArray.from_arrays(ends, x) for x in (terms.take(pa.array(codes[order])), pa.array(weights))]
        return pa.table([t.column(tenant), t.column(doc), *lists], names=[tenant, doc, "terms", "weights"])

    both = texts.groupBy(tenant, "_block").cogroup(words.groupBy(tenant, "_block"))
    return both.applyInArrow(weighed, f"`{tenant}` {kinds[tenant]}, `{doc}` {kinds[doc]}, terms array<string>, weights array<double>")


def _nines(x: np.ndarray) -> np.ndarray:
    """Billionths, rounded as Spark does: by a number's shortest decimals, halves up."""
    scaled = x * 1e9
    out = np.floor(scaled + 0.5).astype(np.int64)
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)
    out[near] = [int(Decimal(repr(v)).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP)) for v in x[near].tolist()]
    return out


def sorted_vector(weights: Column) -> Column:
    """A map of term ids to weights as parallel arrays, ids ascending."""
    entries = F.array_sort(F.map_entries(weights))
    return F.struct(F.transform(entries, lambda e: e["key"]).alias("indices"), F.transform(entries, lambda e: e["value"]).alias("values"))
