"""Retrieval and gating: BM25, dense search, fusion, rerank, reliability, decisions, gate and ranking metrics.

Questions are all of the benchmark's passages, whole. What is indexed are all word windows of each document (J8), and a document
ranks by its best window. Gold are the documents that hold the whole passage, word by word. A question's vector is that
of the first gold document that has one, else the one of its own number; the vectors it is compared with are
those of documents. The index and the vector stores are written once for a table's files. J2 searches with all vectors
whose id is divisible by 20. The SQL states the same over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as X
from ..operators import gate, postings, ranking, reliability, vectors
from ..tables import load

TOP = 5
#: Words of a window and words in common.
SIZE, OVERLAP = 180, 40
#: Every vector whose id is divisible by this is a dense search of J2.
EVERY = 20
#: Weights of the dense and the sparse list, and how long both are, of the first and the second retrieval.
FIRST, SECOND = (0.6, 0.4, 10), (0.4, 0.6, 20)


def _questions(spark, sf) -> DataFrame:
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _terms(spark, sf) -> DataFrame:
    return _questions(spark, sf).select("query_id", F.explode(X.terms(F.col("text"))).alias("term"))


def _index(spark, sf) -> postings.Index:
    docs = load(spark, sf, "documents")
    return storage.shared(docs, "index", lambda path: postings.write(docs.select("doc_id", "text"), SIZE, OVERLAP, path))


def _store(spark, sf, of_documents: bool = False) -> vectors.VectorStore:
    v, label = load(spark, sf, "embeddings"), "vectors"
    rows = v.select("vec_id", "embedding")
    if of_documents:
        docs, label = load(spark, sf, "documents"), "document-vectors"
        rows = rows.join(docs.filter(F.col("text").rlike(r"[^ \n\t\r\f\x0B]")).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return storage.shared(v, label, lambda path: vectors.VectorStore.create(rows, path))


def _sparse(spark, sf, k: int) -> DataFrame:
    """The k best documents of each question, each by its best window (the earliest of equals); written once."""
    return postings.best(_index(spark, sf), _terms(spark, sf), k).withColumnRenamed("doc", "chunk_id")


def j1_bm25(spark, sf):
    return _sparse(spark, sf, 10).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def a14_index(spark, sf):
    """The lexical index written and reread: document frequency and inverse frequency of each term."""
    return _index(spark, sf).stats.select("term", "df", F.round("idf", 6).alias("idf"))


def j2_dense(spark, sf):
    asked = load(spark, sf, "embeddings").filter(F.col("vec_id") % EVERY == 0).select("vec_id", "embedding")
    rows, _ = vectors.nearest(_store(spark, sf), asked, TOP)
    return rows.select("query_id", "rank", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))


def _asked_vectors(spark, sf, gold: DataFrame) -> DataFrame:
    """(query_id, q): the vector of each question's first gold document that has one, else of its own number."""
    v = load(spark, sf, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("at"), F.col("embedding").cast("array<double>").alias("q"))
    own = gold.join(v.select(F.col("at").alias("chunk_id")), "chunk_id", "left_semi").groupBy("query_id").agg(F.min("chunk_id").alias("own"))
    asked = _questions(spark, sf).select("query_id").join(own, "query_id", "left").select("query_id", F.coalesce("own", "query_id").alias("at"))
    return storage.written(asked.join(v, "at").select("query_id", "q"), "asked-vectors")


def _lists(spark, sf, k: int, gold: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The questions' vectors, and their k best documents by product and by terms; each written once."""
    asked = _asked_vectors(spark, sf, _gold(spark, sf) if gold is None else gold)
    dense, _ = vectors.nearest(_store(spark, sf, True), asked, k)
    return asked, dense.withColumnRenamed("id", "chunk_id"), _sparse(spark, sf, k)


def _fused(dense: DataFrame, sparse: DataFrame, setting: tuple) -> DataFrame:
    w_dense, w_sparse, k = setting
    return ranking.fuse(dense.filter(F.col("rank") <= k), sparse.filter(F.col("rank") <= k), w_dense, w_sparse).withColumn("score", F.round("hybrid", 9))


def c5_fusion(spark, sf):
    """Both candidate lists joined, absent scores 0."""
    _, dense, sparse = _lists(spark, sf, 10)
    return _fused(dense, sparse, FIRST).select("query_id", "chunk_id", F.round("dense", 6).alias("dense"), F.round("sparse", 6).alias("sparse"))


def e8_max_norm(spark, sf):
    rows = ranking.max_normalised(_sparse(spark, sf, 10), "query_id", "score")
    return rows.select("query_id", "chunk_id", F.round("norm", 6).alias("norm"))


def j3_hybrid(spark, sf):
    _, dense, sparse = _lists(spark, sf, 10)
    rows = ranking.top_k(_fused(dense, sparse, FIRST), "query_id", "score", "chunk_id", TOP)
    return rows.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _retrieved(spark, sf, lists: tuple, setting: tuple) -> DataFrame:
    """The five best of a fused list with the window that stands for each (the best by terms, else the first), its text, the authority of source
    and text, and the cosine of question and document (0 where the document has no vector)."""
    asked, dense, sparse = lists
    best = ranking.top_k(_fused(dense, sparse, setting), "query_id", "score", "chunk_id", TOP).select("query_id", "rank", "chunk_id")
    best = best.join(sparse.filter(F.col("rank") <= setting[2]).select("query_id", "chunk_id", "window"), ["query_id", "chunk_id"], "left").withColumn("window", F.coalesce("window", F.lit(1)))
    best = storage.written(best, "chosen")  # so that its size is known, and neither texts nor vectors are shuffled to meet it
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = storage.written(v.join(best.select("chunk_id").distinct(), "chunk_id", "left_semi"), "chosen-vectors")
    rows = best.join(docs, "chunk_id").join(v, "chunk_id", "left").join(asked, "query_id", "left").join(_questions(spark, sf).withColumnRenamed("text", "question"), "query_id")
    words = F.filter(F.split("text", r"[ \n\t\r\f\x0B]+"), lambda w: w != "")
    chunk = F.array_join(F.slice(words, (F.col("window") - 1).cast("int") * (SIZE - OVERLAP) + 1, F.lit(SIZE)), " ")
    cosine = F.round(F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 9)
    rows = rows.withColumn("chunk", chunk).withColumn("authority", X.authority_score(X.authority(F.col("source"), F.col("chunk"))))
    rows = rows.select("query_id", "rank", "chunk_id", "question", "chunk", "source", "authority", F.coalesce(cosine, F.lit(0.0)).alias("cosine"))
    return storage.written(rows, "evidence")


def _evidence(spark, sf) -> DataFrame:
    return _retrieved(spark, sf, _lists(spark, sf, FIRST[2]), FIRST)


def j4_rerank(spark, sf):
    """Five candidates ranked again by how much of the question each covers, ties in the first order; three stay."""
    rows = _evidence(spark, sf).withColumn("cover", X.coverage(X.terms(F.col("question")), X.terms(F.col("chunk"))))
    k = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cover"), "rank"))
    return rows.withColumn("place", k).filter("place <= 3").select("query_id", "place", "chunk_id", "cover")


def j6_adapter(spark, sf):
    rows = reliability.adapt(_evidence(spark, sf))
    return rows.select("query_id", "chunk_id", "source_document", "authority_score", "similarity_score")


def j7_aggregate(spark, sf):
    """Evidence lists checked: one row a rank, no empty text, as many as asked for."""
    rows = _evidence(spark, sf)
    return rows.groupBy("query_id").agg(F.count("*").alias("items"), F.countDistinct("rank").alias("ranks"), F.max("rank").alias("last"), F.count_if(F.length("chunk") == 0).alias("empty"))


def c8_conflict(spark, sf):
    return reliability.conflicts(_evidence(spark, sf))


def _judged(spark, sf) -> DataFrame:
    return reliability.reliability(_evidence(spark, sf))


def j12_reliability(spark, sf):
    return _judged(spark, sf).select("query_id", "authority", "relevance", "support", "coverage", "consistency", "overall")


def j13_decision(spark, sf):
    return _judged(spark, sf).select("query_id", "overall", reliability.decision(F.col("overall")).alias("decision"))


def j14_gate(spark, sf):
    """The gate over two retrievals: the second looks deeper and gives terms more weight."""
    lists = _lists(spark, sf, SECOND[2])
    return gate.run(_retrieved(spark, sf, lists, FIRST), _retrieved(spark, sf, lists, SECOND))


def d21_decisions(spark, sf):
    return j14_gate(spark, sf).groupBy(F.concat_ws("->", "first_decision", "final_decision").alias("move")).agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"))


def _words(text):
    return F.filter(F.split(F.lower(text), r"[ \n\t\r\f\x0B]+"), lambda w: w != "")


def _gold(spark, sf) -> DataFrame:
    """(query_id, chunk_id): documents that hold a passage word by word. Such a document holds all of the passage's terms, so the postings
    give the candidates; each is then compared whole. A passage without terms goes by its longest word."""
    words = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text", _words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    q = words.select("query_id", X.terms(F.col("text")).alias("terms"), "w", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("passage"))
    found = postings.holding(_index(spark, sf), q.select("query_id", F.explode("terms").alias("term"))).withColumnRenamed("doc", "chunk_id")
    docs = load(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("chunk_id"), "text")
    other = q.filter(F.size("terms") == 0)
    if not other.isEmpty():
        longest = other.select("query_id", F.array_max(F.transform("w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("word"))
        some = storage.spread(docs).select("chunk_id", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
        found = found.unionByName(some.join(longest, "word").select("query_id", "chunk_id"))
    # documents meet the candidates' ids first, so that texts needn't be shuffled where the ids are few
    met = docs.join(storage.written(found, "candidates"), "chunk_id").join(q.select("query_id", "passage"), "query_id")
    held = met.filter(F.contains(F.concat(F.lit(" "), F.array_join(_words(F.col("text")), " "), F.lit(" ")), "passage"))
    return storage.written(held.select("query_id", "chunk_id").distinct(), "gold")


def c9_goldhit(spark, sf):
    hit = _sparse(spark, sf, 10).join(_gold(spark, sf), ["query_id", "chunk_id"], "left_semi")
    return hit.select("query_id", "chunk_id", "rank")


def e7_first_hit(spark, sf):
    return ranking.first_hits(_sparse(spark, sf, 10), _gold(spark, sf))


def j15_ir(spark, sf):
    found, gold = _sparse(spark, sf, 10), _gold(spark, sf)
    sources = load(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return ranking.metrics(found, gold, [1, 3, 5, 10]).join(ranking.source_accuracy(found, gold, sources), "questions")


def j16_taxonomy(spark, sf):
    """Questions by how many of four settings find gold: A three or more, B one or two, C none."""
    gold = _gold(spark, sf)
    asked = gold.select("query_id").distinct()
    hits = ranking.first_hits(_sparse(spark, sf, 10), gold)
    r = F.col("first_rank")
    n = sum((F.coalesce((r <= k).cast("int"), F.lit(0)) for k in (1, 3, 5, 10)), F.lit(0))
    rows = asked.join(hits, "query_id", "left").select("query_id", n.alias("hits"))
    return rows.select("query_id", "hits", F.when(F.col("hits") >= 3, "A").when(F.col("hits") >= 1, "B").otherwise("C").alias("class"))


def j16_gaps(spark, sf):
    """Each question with gold: which of three retrievers find it among their five best, how many of its terms the first gold document's best
    window holds, the cosine with that document, and how many of the document's other windows share a term, or as many as the best."""
    gold = _gold(spark, sf)
    asked, dense, sparse = _lists(spark, sf, FIRST[2], gold)
    hybrid = ranking.top_k(_fused(dense, sparse, FIRST), "query_id", "score", "chunk_id", TOP)
    of = lambda rows, name: rows.filter(F.col("rank") <= TOP).select("query_id", "chunk_id", F.lit(name).alias("by"))
    runs = of(dense, "dense").unionByName(of(sparse, "sparse")).unionByName(of(hybrid, "hybrid"))
    hit = runs.join(gold, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(*(F.max((F.col("by") == b).cast("int")).alias(b) for b in ("dense", "sparse", "hybrid")))
    first = gold.groupBy("query_id").agg(F.min("chunk_id").alias("doc"))
    terms = _terms(spark, sf).distinct()
    index = _index(spark, sf)
    wanted = storage.written(first.join(terms, "query_id").withColumn("seg", postings.segment(F.col("doc"), index.segments)), "wanted")
    lots = wanted.join(index.blocks, ["term", "seg"]).filter("doc between first and last").select("query_id", "term", "doc", F.explode(F.arrays_zip("docs", "windows")).alias("x"))
    held = lots.filter(F.col("x.docs") == F.col("doc")).groupBy("query_id", "x.windows").agg(F.count("*").alias("n"))
    # how many windows hold how many terms: a count of those not below the best, in place of pairs of windows
    sizes = held.groupBy("query_id", "n").agg(F.count("*").alias("windows")).groupBy("query_id").agg(F.max(F.struct("n", "windows")).alias("best"), F.sum("windows").alias("sharing"))
    v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").cast("array<double>").alias("v"))
    rows = first.join(terms.groupBy("query_id").agg(F.count("*").alias("terms")), "query_id", "left").join(sizes, "query_id", "left").join(hit, "query_id", "left").join(asked, "query_id", "left").join(v, "doc", "left")
    found = {b: F.coalesce(b, F.lit(0)) for b in ("dense", "sparse", "hybrid")}
    gap = F.when(found["dense"] + found["sparse"] + found["hybrid"] == 0, "ALL").when((found["dense"] == 0) & (found["sparse"] == 0), "BOTH").when(found["sparse"] == 0, "LEXICAL").when(found["dense"] == 0, "SEMANTIC").otherwise("NONE")
    return rows.select(
        "query_id", *(c.alias(b) for b, c in found.items()), gap.alias("gap"), F.round(F.coalesce(F.col("best.n") / F.col("terms"), F.lit(0.0)), 6).alias("lexical"),
        F.round(F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 6).alias("semantic"),
        F.greatest(F.coalesce(F.col("sharing"), F.lit(0)) - 1, F.lit(0)).alias("sharing"), F.coalesce(F.col("best.windows") - 1, F.lit(0)).alias("competing"),
    )


# SQL

from ..operators.reliability import OPPOSED  # noqa: E402
from .corpus import _TERMS, _WORDS, _windows_sql  # noqa: E402

_ST = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"
_CH = f"with d as (select * from documents where text is not null), wd as ({_windows_sql(SIZE, OVERLAP)}), ch as (select wd.doc_id as chunk_id, wd.chunk_id as win, array_to_string(c, ' ') as text, source from wd join d using (doc_id))"
_Q = ", q as (select item_id as query_id, text from benchmark)"
_BM = _CH + _Q + f""", tk as (select chunk_id, win, unnest({_TERMS.format('text')}) as term from ch), tf as (select chunk_id, win, term, count(*) as tf from tk group by all), dl as (select chunk_id, win, sum(tf) as dl from tf group by all),
  nn as (select count(*)::double as n, (select sum(dl) from dl) / count(*)::double as avgdl from ch), df as (select term, count(*) as df from tf group by 1),
  i0 as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, nn), id as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from i0) else raw end as idf from i0),
  qt as (select query_id, term, count(*) as times from (select query_id, unnest({_TERMS.format('text')}) as term from q) group by all),
  sc as (select query_id, chunk_id, win, round(sum(times * (idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 9) as score from qt join tf using (term) join id using (term) join dl using (chunk_id, win), nn group by all),
  bw as (select * from sc qualify row_number() over (partition by query_id, chunk_id order by score desc, win) = 1),
  sx as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from bw qualify rank <= {SECOND[2]}), sp as (select * from sx where rank <= {FIRST[2]})"""
_DN = f""", dn as (select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select a.vec_id as query_id, b.vec_id as chunk_id,
  round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) as score from embeddings a join embeddings b on a.vec_id % {EVERY} = 0)) where rank <= 10)"""
_NORM = f"' ' || array_to_string({_WORDS.replace('text', 'lower(text)')}, ' ') || ' '"
_GO = f", bn as (select item_id as query_id, {_NORM} as p from benchmark where len({_WORDS}) > 0), dw as (select doc_id as chunk_id, {_NORM} as t from documents where text is not null), g as (select query_id, chunk_id from bn join dw on contains(t, p))"


def _fused_sql(name: str, setting: tuple) -> str:
    w_dense, w_sparse, k = setting
    norm = "case when max(score) over (partition by query_id) > 0 then score / max(score) over (partition by query_id) else 0.0 end as n"
    return f""", {name} as (select coalesce(d.query_id, s.query_id) as query_id, coalesce(d.chunk_id, s.chunk_id) as chunk_id, coalesce(d.n, 0.0) as dense, coalesce(s.n, 0.0) as sparse,
  round({w_dense}::double * coalesce(d.n, 0.0) + {w_sparse}::double * coalesce(s.n, 0.0), 9) as score
  from (select *, {norm} from qd where rank <= {k}) d full join (select *, {norm} from sx where rank <= {k}) s on d.query_id = s.query_id and d.chunk_id = s.chunk_id)"""


#: Questions' vectors, and their products with the documents' vectors.
_QD = f""", em as (select vec_id, embedding::double[] as v from embeddings where embedding is not null), dv as (select * from em where vec_id in (select chunk_id from ch)),
  qo as (select query_id, min(chunk_id) as own from g where chunk_id in (select vec_id from em) group by 1), qv as (select q.query_id, em.v from q left join qo using (query_id) join em on em.vec_id = coalesce(own, q.query_id)),
  qd as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select query_id, vec_id as chunk_id, round(list_dot_product(qv.v, dv.v), 9) as score from qv, dv) qualify rank <= {SECOND[2]})"""
_FU = _BM + _GO + _QD + _fused_sql("fu", FIRST)


def _evidence_sql(name: str, fused: str, setting: tuple) -> str:
    said = "lower(concat_ws(' ', source, chunk[1:2000]))"
    label = f"case when contains({said}, 'world health organization') then 1.0 when contains({said}, 'national institute on aging') or contains({said}, 'national institutes of health') or contains({said}, 'centers for disease control') then 0.95 when contains({said}, '.gov') or contains({said}, 'government') then 0.9 when len(source) > 0 then 0.85 else 0.5 end::double"
    return f""", {name}0 as (select query_id, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank, chunk_id from {fused} qualify rank <= {TOP}),
  {name}1 as (select e.query_id, e.rank, e.chunk_id, q.text as question, ch.text as chunk, ch.source, coalesce(round(list_dot_product(qv.v, em.v), 9), 0.0) as cosine
    from {name}0 e left join (select query_id, chunk_id, win from sx where rank <= {setting[2]}) w using (query_id, chunk_id) join ch on ch.chunk_id = e.chunk_id and ch.win = coalesce(w.win, 1)
    join q on q.query_id = e.query_id left join qv on qv.query_id = e.query_id left join em on em.vec_id = e.chunk_id),
  {name} as (select *, {label} as authority from {name}1)"""


_EV = _FU + _evidence_sql("ev", "fu", FIRST)


def _opposed(a: str, b: str) -> str:
    one = lambda x, y, p, n: f"(contains(lower({x}), '{p}') and not contains(lower({x}), 'not {p}') and contains(lower({y}), '{n}'))"
    return "(" + " or ".join(one(a, b, p, n) + " or " + one(b, a, p, n) for p, n in OPPOSED) + ")"


_TT = "list_distinct(" + _TERMS + ")"
_RL = f""", cf as (select a.query_id, count(*) as pairs, count(*) filter ({_opposed('a.chunk', 'b.chunk')} and len(list_intersect({_TT.format('a.chunk')}, {_TT.format('b.chunk')})) >= 3) as conflicts
    from {{src}} a join {{src}} b on a.query_id = b.query_id and a.rank < b.rank group by 1),
  it as (select *, {_TT.format('question')} as qt, list_intersect({_TT.format('question')}, {_TT.format('chunk')}) as hit from {{src}}),
  ag as (select query_id, avg(authority) as authority, avg((cosine + 1) / 2) as relevance, avg(case when len(hit) >= 2 then 1.0 else 0.0 end) as s0, len(any_value(qt)) as nq,
    len(list_distinct(flatten(list(hit)))) as nh from it group by 1),
  rl as (select ag.query_id, round(authority, 6) as authority, round(relevance, 6) as relevance, round(case when nq > 0 then s0 else relevance end, 6) as support, round(case when nq > 0 then nh / nq::double else relevance end, 6) as coverage,
    round(1.0 - coalesce(conflicts / pairs::double, 0.0), 6) as consistency from ag left join cf using (query_id)),
  jd as (select *, round(0.3::double * authority + 0.3::double * relevance + 0.2::double * support + 0.1::double * coverage + 0.1::double * consistency, 6) as overall from rl)"""
_DECIDE = "case when {0} >= 0.8 then 'ACCEPT' when {0} >= 0.65 then 'REFINE' when {0} >= 0.45 then 'RE-RETRIEVE' else 'REJECT' end"
_HI = _BM + _GO + ", hi as (select query_id, min(rank) as r from sp join g using (query_id, chunk_id) group by 1), aq as (select query_id, count(*) as gold from g group by 1), al as (select aq.query_id, gold, r from aq left join hi using (query_id))"
SQL = {
    "j1_bm25": _BM + " select query_id, cast(rank as integer) as rank, chunk_id, round(score, 6) as score from sp",
    "a14_index": _BM + " select term, df, round(idf, 6) as idf from id",
    "j2_dense": _CH + _DN + " select query_id, cast(rank as integer) as rank, chunk_id, round(score, 6) as score from dn where rank <= 5",
    "c5_fusion": _FU + " select query_id, chunk_id, round(dense, 6) as dense, round(sparse, 6) as sparse from fu",
    "e8_max_norm": _BM + " select query_id, chunk_id, round(case when max(score) over (partition by query_id) > 0 then score / max(score) over (partition by query_id) else 0.0 end, 6) as norm from sp",
    "j3_hybrid": _FU + " select query_id, cast(rank as integer) as rank, chunk_id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from fu) where rank <= 5",
    "j4_rerank": _EV + f", c as (select query_id, rank, chunk_id, case when len({_TERMS.format('question')}) = 0 then 1.0 else round(len(list_filter({_TERMS.format('question')}, lambda w: list_contains({_TERMS.format('chunk')}, w))) / len({_TERMS.format('question')})::double, 4) end as cover from ev) select query_id, cast(place as integer) as place, chunk_id, cover from (select *, row_number() over (partition by query_id order by cover desc, rank) as place from c) where place <= 3",
    "j6_adapter": _EV + " select query_id, chunk_id, source as source_document, authority as authority_score, greatest(-1.0::double, least(1.0::double, cosine)) as similarity_score from ev",
    "j7_aggregate": _EV + " select query_id, count(*) as items, count(distinct rank) as ranks, max(rank) as last, count(*) filter (length(chunk) = 0) as empty from ev group by 1",
    "c8_conflict": _EV + f" select a.query_id, a.rank as left_rank, b.rank as right_rank, {_opposed('a.chunk', 'b.chunk')} and len(list_intersect({_TT.format('a.chunk')}, {_TT.format('b.chunk')})) >= 3 as conflict from ev a join ev b on a.query_id = b.query_id and a.rank < b.rank",
    "j12_reliability": _EV + _RL.replace("{src}", "ev") + " select query_id, authority, relevance, support, coverage, consistency, overall from jd",
    "j13_decision": _EV + _RL.replace("{src}", "ev") + f" select query_id, overall, {_DECIDE.format('overall')} as decision from jd",
    "c9_goldhit": _BM + _GO + " select query_id, chunk_id, cast(rank as integer) as rank from sp join g using (query_id, chunk_id)",
    "e7_first_hit": _HI + " select query_id, gold, cast(r as integer) as first_rank, round(coalesce(1.0::double / r, 0.0), 6) as reciprocal from al",
    "j15_ir": _HI + """ select count(*) as questions, """ + ", ".join(f"round(avg(case when r <= {k} then 1.0 else 0.0 end), 6) as recall_{k}" for k in (1, 3, 5, 10)) + """, round(avg(coalesce(1.0::double / r, 0.0)), 6) as mrr, round(avg(coalesce(case when r <= 5 then 1.0::double / log2(r + 1) end, 0.0)), 6) as ndcg_log2_5,
      round(avg(coalesce((select sum(1.0::double / (rank + 1)) from sp join g using (query_id, chunk_id) where query_id = al.query_id and rank <= 5), 0.0) / (select sum(1.0::double / (i + 1)) from (select unnest(generate_series(1, least(5, gold))) as i))), 6) as ndcg_harmonic_5,
      round(avg((select count(*) from sp join g using (query_id, chunk_id) where query_id = al.query_id and rank <= 5) / 5.0::double), 6) as precision_5,
      """ + ", ".join(f"round(avg((select count(*) from sp join g using (query_id, chunk_id) where query_id = al.query_id and rank <= {k}) / gold::double), 6) as share_{k}" for k in (1, 3, 5, 10)) + """,
      round(avg(coalesce((select sum(i / rank::double) from (select query_id, rank, row_number() over (partition by query_id order by rank) as i from sp join g using (query_id, chunk_id)) where query_id = al.query_id), 0.0) / gold), 6) as map,
      round(avg(case when exists (select 1 from sp join documents a on a.doc_id = sp.chunk_id join g on g.query_id = sp.query_id join documents b on b.doc_id = g.chunk_id where sp.query_id = al.query_id and sp.rank = 1 and lower(trim(a.source)) = lower(trim(b.source))) then 1.0 else 0.0 end), 6) as source_accuracy from al""",
    "j16_taxonomy": _HI + " select query_id, cast(h as integer) as hits, case when h >= 3 then 'A' when h >= 1 then 'B' else 'C' end as class from (select query_id, " + " + ".join(f"case when r <= {k} then 1 else 0 end" for k in (1, 3, 5, 10)) + " as h from al)",
}
_SETS = _EV + _fused_sql("fu2", SECOND) + _evidence_sql("ev2", "fu2", SECOND) + f""", two as (select *, 's1' as k from ev union all select *, 's2' as k from ev2),
  more as (select * from two union all select * replace (replace(k, 's', 'r') as k) from two where len(list_intersect({_TT.format('question')}, {_TT.format('chunk')})) >= 2),
  four as (select * exclude (query_id), query_id || ' ' || k as query_id from more)"""
_GATE = _SETS + _RL.replace("{src}", "four") + f""", sc4 as (select cast(string_split(query_id, ' ')[1] as bigint) as query_id, string_split(query_id, ' ')[2] as k, overall from jd),
  pv as (select query_id, {", ".join(f"max(overall) filter (k = '{k}') as {k}" for k in ("s1", "r1", "s2", "r2"))} from sc4 group by 1),
  de as (select query_id, r1 is null as e1, r2 is null as e2, {", ".join(f"{_DECIDE.format(k)} as d{k}" for k in ("s1", "r1", "s2", "r2"))} from pv),
  st as (select *, ds1 = 'REFINE' as refined1, ds1 = 'RE-RETRIEVE' or (ds1 = 'REFINE' and not e1 and dr1 = 'RE-RETRIEVE') as again,
    case when ds1 = 'REFINE' then case when e1 then 'REFUSED' else dr1 end else ds1 end as after1 from de),
  s3 as (select *, again and not refined1 and ds2 = 'REFINE' as refined2 from st), s4 as (select *, case when again then case when refined2 then case when e2 then 'REFUSED' else dr2 end else ds2 end else after1 end as final from s3),
  gt as (select query_id, ds1 as first_decision, final as final_decision, case when again then 2 else 1 end as retrievals, case when refined1 or refined2 then 1 else 0 end as refinements, final in ('REFUSED', 'REJECT', 'RE-RETRIEVE') as refused,
    case final when 'REFUSED' then 'REFINE_EMPTY' when 'REJECT' then 'REJECTED' when 'RE-RETRIEVE' then 'RETRIEVAL_BUDGET' else '' end as why from s4)"""
SQL["j14_gate"] = _GATE + " select * from gt"
SQL["d21_decisions"] = _GATE + " select first_decision || '->' || final_decision as move, count(*) as n, count(*) filter (refused) as refused from gt group by 1"
SQL["j16_gaps"] = _FU + f""", hy as (select query_id, chunk_id from fu qualify row_number() over (partition by query_id order by score desc, chunk_id) <= {TOP}),
  runs as (select query_id, chunk_id, 'dense' as who from qd where rank <= {TOP} union all select query_id, chunk_id, 'sparse' from sp where rank <= {TOP} union all select query_id, chunk_id, 'hybrid' from hy),
  hs as (select query_id, max((who = 'dense')::int) as dense, max((who = 'sparse')::int) as sparse, max((who = 'hybrid')::int) as hybrid from runs join g using (query_id, chunk_id) group by 1),
  g1 as (select query_id, min(chunk_id) as doc from g group by 1), qs as (select query_id, list(distinct term) as t from qt group by 1),
  hd as (select query_id, win, len(list_intersect(qs.t, {_TT.format('ch.text')})) as n from g1 join qs using (query_id) join ch on ch.chunk_id = doc),
  sz as (select query_id, max(n) as best, count(*) as sharing, count(*) filter (n = top) as windows from (select *, max(n) over (partition by query_id) as top from hd where n > 0) group by 1),
  fi as (select g1.query_id, coalesce(dense, 0) as dense, coalesce(sparse, 0) as sparse, coalesce(hybrid, 0) as hybrid, coalesce(best / len(t)::double, 0.0) as lex, list_dot_product(qv.v, em.v) as sem, coalesce(sharing, 0) as sh, coalesce(windows - 1, 0) as competing
    from g1 left join qs using (query_id) left join sz using (query_id) left join hs using (query_id) left join qv using (query_id) left join em on em.vec_id = doc)
  select query_id, dense, sparse, hybrid, case when dense + sparse + hybrid = 0 then 'ALL' when dense = 0 and sparse = 0 then 'BOTH' when sparse = 0 then 'LEXICAL' when dense = 0 then 'SEMANTIC' else 'NONE' end as gap,
    round(lex, 6) as lexical, round(sem, 6) as semantic, greatest(sh - 1, 0) as sharing, competing from fi"""
QUERIES = {name: globals()[name] for name in SQL}
