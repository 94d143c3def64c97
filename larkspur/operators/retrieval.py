"""Retrieval: BM25 postings, character n-grams, dense scores, priors learned from a log, and their unions.

Indexes are long tables of postings; a score is an equi join on the term and a sum, so no query meets a document that shares
nothing with it, and Catalyst picks the join. Top-k is a window on row_number, for which Spark adds a per-partition group limit
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# BM25's parameters, the priors' smoothing and the weights of the hybrid score.
K1, B = 1.2, 0.75
ALPHA, SAME, OTHER, UNSEEN, EPS = 5.0, 0.77, 0.23, 1e-6, 1e-7


def top_k(scores: DataFrame, k: int, group: str, item: str, score: str = "score") -> DataFrame:
    """The k best of each group, ties to the smaller item, with their rank."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(item))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_index(docs: DataFrame, doc: str, toks: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(term, doc, weight) over token arrays; dl counts repeats, and empty documents count in the average.

    vocabulary: (term); other terms then count nowhere, not even in dl."""
    terms = docs.select(F.col(doc).alias("doc"), F.size(toks).cast("long").alias("dl"), F.explode(toks).alias("term"))
    if vocabulary is None:
        total = docs.agg(F.count("*").alias("n"), F.sum(F.greatest(F.size(toks), F.lit(0))).alias("total"))  # one row
    else:
        terms = terms.join(vocabulary.select("term").distinct(), "term", "left_semi")
        terms = terms.drop("dl").join(terms.groupBy("doc").agg(F.count("*").alias("dl")), "doc")
        total = docs.agg(F.count("*").alias("n")).crossJoin(terms.agg(F.count("*").alias("total")))  # one row
    tf = terms.groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    x = tf.join(df, "term").crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.col("dl") / (F.col("total") / F.col("n"))
    return x.select("term", "doc", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length)) * idf).alias("weight"))


def query_terms(queries: DataFrame, query: str, toks: str) -> DataFrame:
    """(q, term), each term once."""
    return queries.select(F.col(query).alias("q"), F.explode(F.array_distinct(toks)).alias("term"))


def bm25_scores(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(q, doc, score, n_terms): summed weights and the number of query terms the document has."""
    return terms.join(index, "term").groupBy("q", "doc").agg(F.sum("weight").alias("score"), F.count("*").alias("n_terms"))


def char_grams(s: Column) -> Column:
    """Character 3-grams inside words that are padded with a space on each side."""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(3))))
    return F.flatten(grams)


def tfidf(docs: DataFrame, doc: str, grams: str, min_df: int = 2) -> tuple[DataFrame, DataFrame]:
    """(gram, idf) and unit rows (doc, gram, w): sublinear tf, smooth idf, grams in min_df documents or more."""
    tf = docs.select(F.col(doc).alias("doc"), F.explode(grams).alias("gram")).groupBy("doc", "gram").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    idf = tf.groupBy("gram").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df).crossJoin(F.broadcast(n))
    idf = idf.select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return idf, unit_rows(tf, idf)


def unit_rows(tf: DataFrame, idf: DataFrame) -> DataFrame:
    raw = tf.join(idf, "gram").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "gram", (F.col("w") / norm).alias("w"))


def cosine(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, doc, score) of unit rows that share a gram."""
    q = queries.select(F.col("doc").alias("q"), "gram", F.col("w").alias("wq"))
    return q.join(docs, "gram").groupBy("q", "doc").agg(F.sum(F.col("wq") * F.col("w")).alias("score"))


def log_shares(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the location prior is made of, from log (sloc, iloc): (sloc, iloc, cnt), (sloc, n_s) and (iloc, share)."""
    cnt = log.groupBy("sloc", "iloc").agg(F.count("*").alias("cnt"))
    g = cnt.groupBy("iloc").agg(F.sum("cnt").alias("g_n")).crossJoin(F.broadcast(cnt.agg(F.sum("cnt").alias("g_all"))))
    return cnt, cnt.groupBy("sloc").agg(F.sum("cnt").alias("n_s")), g.select("iloc", (F.col("g_n") / F.col("g_all")).alias("share"))


def location_prior(shares: tuple[DataFrame, DataFrame, DataFrame], pairs: DataFrame, shrink_unseen: bool = True) -> DataFrame:
    """pairs (sloc, iloc, ...) with p, lp = ln(p + 1e-7) and loc_cnt, from ``log_shares``.

    Smoothed towards the items' global shares (1e-6 if unseen); a search location without log gives 0.77 to itself and to the others
    0.23 times the share (shrink_unseen), or the share itself. Only the pairs asked for are looked up."""
    cnt, n, g = shares
    x = pairs.join(cnt, ["sloc", "iloc"], "left").join(n, "sloc", "left").join(g, "iloc", "left")
    base = F.coalesce("share", F.lit(UNSEEN))
    same = F.col("sloc") == F.col("iloc")
    seen = (F.coalesce("cnt", F.lit(0)) + ALPHA * base) / (F.col("n_s") + ALPHA)
    unseen = F.when(same, F.lit(SAME)).otherwise(OTHER * base if shrink_unseen else base)
    p = F.when(F.col("n_s").isNotNull(), seen).otherwise(unseen)
    count = F.when(F.col("n_s").isNotNull(), F.coalesce("cnt", F.lit(0)).cast("double")).otherwise(same.cast("double"))
    return x.select(*pairs.columns, p.alias("p"), F.log(p + EPS).alias("lp"), count.alias("loc_cnt"))


def smoothed_rate(rows: DataFrame, key: str, value: str, a: float, g: DataFrame | None = None) -> DataFrame:
    """(key, rate): (sum + a * overall mean) / (count + a); g: the overall mean, one row, if it isn't the rows' own."""
    g = rows.agg(F.avg(value).alias("g")) if g is None else g
    return rows.groupBy(key).agg(F.sum(value).alias("s"), F.count("*").alias("n")).crossJoin(F.broadcast(g)).select(key, ((F.col("s") + a * F.col("g")) / (F.col("n") + a)).alias("rate"))


def exact_microcategory(log: DataFrame) -> DataFrame:
    """(query, mc, p): the share of a logged text's choices."""
    n = log.groupBy("query", "mc").agg(F.count("*").alias("n"))
    return n.select("query", "mc", (F.col("n") / F.sum("n").over(Window.partitionBy("query"))).alias("p"))


def token_bayes(log: DataFrame, all_mcs: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, mc, lift): mean over the query's known tokens of ln((n(t, mc) + 2 prior) / (n(t) + 2)), less ln prior.

    log: (toks, mc), tokens counted once a row; all_mcs: (mc) of log and corpus; queries: (q, toks). Unknown tokens don't count; a
    query of unknown tokens has no rows. Only seen (token, microcategory) pairs are joined: what they add to the logarithm of an unseen
    pair is summed, and that of the others follows from the number of tokens."""
    n_mc = log.groupBy("mc").agg(F.count("*").alias("c"))
    total = log.agg(F.count("*").alias("l")).crossJoin(all_mcs.agg(F.countDistinct("mc").alias("m")))  # one row
    prior = all_mcs.select("mc").distinct().join(n_mc, "mc", "left").crossJoin(F.broadcast(total))
    prior = prior.select("mc", ((F.coalesce("c", F.lit(0)) + 1) / (F.col("l") + F.col("m"))).alias("prior"))
    pair = log.select(F.explode(F.array_distinct("toks")).alias("t"), "mc").groupBy("t", "mc").agg(F.count("*").alias("n"))
    tok = pair.groupBy("t").agg(F.sum("n").alias("nt"))
    asked = queries.select("q", F.explode(F.array_distinct("toks")).alias("t"))
    known = asked.join(tok, "t").groupBy("q").agg(F.count("*").alias("k"), F.sum(F.log(F.col("nt") + 2)).alias("rest"))
    more = asked.join(pair, "t").join(prior, "mc").groupBy("q", "mc").agg(F.sum(F.log((F.col("n") + 2 * F.col("prior")) / (2 * F.col("prior")))).alias("more"))
    every = prior.agg(F.collect_list(F.struct("mc", "prior")).alias("all"))  # one row of the microcategories' dimension
    grid = known.crossJoin(F.broadcast(every)).select("q", "k", "rest", F.explode("all").alias("x")).select("q", "k", "rest", "x.*")
    lift = (F.coalesce("more", F.lit(0.0)) + F.col("k") * F.log(2 * F.col("prior")) - F.col("rest")) / F.col("k") - F.log("prior")
    return grid.join(more, ["q", "mc"], "left").select("q", "mc", lift.alias("lift"))


def neighbours(top: DataFrame, tau: float = 0.05) -> DataFrame:
    """top (q, doc, score) with softmax weights."""
    w = Window.partitionBy("q")
    e = F.exp((F.col("score") - F.max("score").over(w)) / tau)
    return top.withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(w)).drop("e")


def transfer(near: DataFrame, labels: DataFrame) -> DataFrame:
    """(q, label, w): the neighbours' label shares, weighted. labels: (doc, label, p)."""
    return near.join(labels, "doc").groupBy("q", "label").agg(F.sum(F.col("weight") * F.col("p")).alias("w"))


def heavy_terms(near: DataFrame, doc_terms: DataFrame, terms: int = 30, least: float = 0.02) -> DataFrame:
    """(q, term, w): pseudo-relevance feedback asks for the heaviest terms of the neighbours (ties by term)."""
    bag = near.join(doc_terms, "doc").groupBy("q", "term").agg(F.sum(F.col("weight") * F.col("p")).alias("w"))
    return top_k(bag.withColumn("by", F.round("w", 9)), terms, "q", "term", "by").filter(F.col("w") > least).select("q", "term", "w")


def union_candidates(retrieved: list[DataFrame]) -> DataFrame:
    """(q, doc) that any retriever gives, once."""
    out = retrieved[0].select("q", "doc")
    for r in retrieved[1:]:
        out = out.unionByName(r.select("q", "doc"))
    return out.distinct()
