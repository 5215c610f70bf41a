"""Corpus queries over documents and pages: text expressions, classification, chunks, duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scores import pct
from ..operators import chunking, similarity
from ..tables import load

# fixed values: document classes by pattern, first match wins, and topic words
CLASSES = [("TABLE", r" \| "), ("LICENSED", r"Licensed under"), ("NOISE", r"###|%%%"), ("PROSE", r"[a-z]{4,} [a-z]{4,}")]
TOPICS = {"alpha": ["the", "and"], "beta": ["die", "und"], "gamma": ["les", "et"], "delta": ["los", "un"]}


def _docs(spark, sf):
    return load(spark, sf, "documents").filter("text is not null")


def b14_clean(spark, sf):
    return _docs(spark, sf).select("doc_id", X.clean(F.col("text")).alias("text"))


def b15_norm(spark, sf):
    return _docs(spark, sf).select("doc_id", X.normalise_span(F.col("text")).alias("text"))


def b16_titles(spark, sf):
    t = F.split("text", "\n")[0]
    return _docs(spark, sf).select("doc_id", X.title_key(t).alias("title"), X.file_key(F.concat("source", F.lit("_"), "lang", F.lit(".PDF"))).alias("file"))


def b17_tags(spark, sf):
    html = F.col("html")
    bare = F.btrim(F.regexp_replace(F.replace(F.replace(F.regexp_replace(html, "<[^>]*>", " "), F.lit("&amp;"), F.lit("&")), F.lit("&copy;"), F.lit("©")), r"[ \n\t]+", " "), F.lit(" "))
    return load(spark, sf, "pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.length(bare).cast("long").alias("chars"), F.md5(bare.cast("binary")).alias("digest"))


def b18_tokens(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id", F.size(X.split_words(t)).cast("long").alias("words"), F.size(X.terms(t)).cast("long").alias("terms"),
        F.size(X.content_tokens(t)).cast("long").alias("content"), F.size(X.content_tokens(t, True)).cast("long").alias("specific"), F.size(X.letter_tokens(t)).cast("long").alias("letters"),
    )


def b19_sentences(spark, sf):
    s = X.sentences(F.regexp_replace("text", "\n", " "))
    return _docs(spark, sf).select("doc_id", F.size(s).cast("long").alias("sentences"))


def b20_classify(spark, sf):
    label, confidence = X.first_match(F.col("text"), CLASSES)
    return _docs(spark, sf).select("doc_id", label.alias("label"), confidence.alias("confidence"))


def b21_license(spark, sf):
    t = F.concat_ws(" ", F.when(F.col("doc_id") % 3 == 0, "Creative Commons BY").when(F.col("doc_id") % 3 == 1, "https://creativecommons.org/licenses/by-nc/4.0"), F.col("text"))
    return _docs(spark, sf).select("doc_id", X.license_category(t).alias("category"))


def b22_authority(spark, sf):
    name = F.when(F.col("doc_id") % 5 == 0, "World Health Organization").when(F.col("doc_id") % 5 == 1, "www.cdc.gov").when(F.col("doc_id") % 5 == 2, "").otherwise(F.col("source"))
    label = X.authority(name, F.col("text"))
    return _docs(spark, sf).select("doc_id", label.alias("authority"), X.authority_score(label).alias("score"))


def b23_topic(spark, sf):
    """Topics by weighted keyword hits: those of at least 2, else the best of at least 1."""
    fields = [(F.split("text", "\n")[0], 3.0), (F.col("text"), 1.0)]
    scores = F.array(*(F.struct(F.lit(n).alias("topic"), X.keyword_score(fields, w).alias("score")) for n, w in TOPICS.items()))
    rows = _docs(spark, sf).select("doc_id", F.explode(scores).alias("t")).select("doc_id", "t.*")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "topic"))
    rows = rows.withColumn("k", k).withColumn("most", F.max("score").over(Window.partitionBy("doc_id")))
    return rows.filter((F.col("score") >= 2) | ((F.col("most") < 2) & (F.col("k") == 1) & (F.col("score") >= 1))).select("doc_id", "topic", "score")


def b24_longest(spark, sf):
    """The longest word, the earliest of equals, with its length."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    best = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return _docs(spark, sf).select("doc_id", best.alias("word"))


def _passages(spark, sf):
    """Each benchmark passage with a document of the same number, a bounded pair for overlap measures."""
    b = load(spark, sf, "benchmark").select("item_id", F.col("text").alias("span"))
    return b.join(_docs(spark, sf).select(F.col("doc_id").alias("item_id"), "text"), "item_id")


def b26_fuzzy(spark, sf):
    """A passage's terms that have a fuzzy equal among the whole text's."""
    rows = _passages(spark, sf)
    return rows.select("item_id", X.fuzzy_share(X.terms(F.col("span")), F.array_distinct(X.terms(F.col("text")))).cast("long").alias("matches"))


def b27_span_cov(spark, sf):
    return _passages(spark, sf).select("item_id", X.coverage(X.content_tokens(F.col("span")), X.content_tokens(F.col("text"))).alias("coverage"))


def b28_jaccard(spark, sf):
    rows = _passages(spark, sf)
    return rows.select("item_id", F.round(X.jaccard(F.array_distinct(X.terms(F.col("span"))), F.array_distinct(X.terms(F.col("text")))), 6).alias("jaccard"))


def b29_locate(spark, sf):
    """Where a line of a document is found, raw or normalised."""
    rows = _docs(spark, sf).withColumn("needle", F.element_at(F.split("text", "\n"), -1))
    raw = F.instr("text", F.col("needle"))
    return rows.select("doc_id", raw.cast("long").alias("at"), F.when(raw > 0, "RAW").otherwise("NONE").alias("how"))


def b30_screen(spark, sf):
    """The first failing rule of a cascade, PASS if none."""
    t, words = F.col("text"), F.size(F.split("text", " "))
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    reason = (
        F.when(F.length(t) < 200, "TOO_SHORT").when(words < 20, "FEW_WORDS").when(words > 5000, "TOO_LONG").when(letters / F.length(t) < 0.5, "FEW_LETTERS")
        .when(t.contains("###") | t.contains("%%%"), "NOISE").when(F.upper(t) == t, "SHOUTING").when(t.contains("@"), "HAS_ADDRESS").otherwise("PASS")
    )
    counts = _docs(spark, sf).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def b31_answer(spark, sf):
    t = F.concat(F.lit("<think>a\nb</think> Answer: "), F.col("text"), F.lit("\nSources:\n1. x"))
    return load(spark, sf, "conversations").filter("text is not null").select("conv_id", "turn", X.answer_only(t).alias("answer"))


def b32_prompt(spark, sf):
    """Each conversation as numbered lines with whole messages in order, the last user message apart."""
    rows = load(spark, sf, "conversations").filter("text is not null")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.format_string("[%d] %s: %s", F.col("turn"), F.col("role"), F.col("text")).alias("line"))))
    last = F.max_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"), F.md5(last.cast("binary")).alias("question"))


def b33_strip(spark, sf):
    """HTML without what lies between two markers; null where they are missing."""
    html = F.col("html")
    a, b = F.instr(html, F.lit("<nav>")), F.instr(html, F.lit("</nav>"))
    cut = F.when((a > 0) & (b > a), F.concat(F.expr("substr(html, 1, instr(html, '<nav>') - 1)"), F.expr("substr(html, instr(html, '</nav>') + 6)")))
    return load(spark, sf, "pages").select("page_id", F.length(cut).cast("long").alias("chars"), F.md5(cut.cast("binary")).alias("digest"))


def b36_lists(spark, sf):
    raw = F.concat(F.col("p_name"), F.lit(", ,"), F.col("p_type"), F.lit(" ,"))
    return load(spark, sf, "part").select("p_partkey", F.array_join(X.listed(raw), "|").alias("items"))


def b37_language(spark, sf):
    return load(spark, sf, "documents").groupBy(X.language(F.concat(F.lit(" "), F.upper("lang"))).alias("language")).agg(F.count("*").alias("n"))


def b39_filter(spark, sf):
    rows = load(spark, sf, "documents").filter("lang in ('en', 'de') and n_chars >= 360 and source is not null")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def j8_chunks(spark, sf):
    c = chunking.word_windows(_docs(spark, sf).select("doc_id", "text"), 180, 40)
    return c.select("doc_id", "chunk_id", "words", F.md5(F.col("chunk").cast("binary")).alias("digest"))


def j9_structured(spark, sf):
    """Paragraphs gathered to chunks of up to 220 words, long ones cut at sentences; no SQL, tested on short examples."""
    c = chunking.paragraph_chunks(_docs(spark, sf).select("doc_id", "text"), 220, 300)
    return c.select("doc_id", "chunk_id", "words", F.md5(F.col("chunk").cast("binary")).alias("digest"))


def j10_sweep(spark, sf):
    return chunking.sweep(_docs(spark, sf).select("doc_id", "text"), [(120, 30), (180, 40), (250, 50)])


def e9_numbering(spark, sf):
    """Chunk ids of a document and the running number of each."""
    c = chunking.word_windows(_docs(spark, sf).select("doc_id", "text"), 180, 40)
    return c.select("doc_id", F.format_string("doc%06d__%05d", F.col("doc_id"), F.col("chunk_id")).alias("id"), "chunk_id")


def d25_coverage(spark, sf):
    """Words in more than one chunk, and chunks that start before the one before them."""
    c = chunking.word_windows(_docs(spark, sf).select("doc_id", "text"), 180, 40).select("doc_id", "chunk_id", F.col("start").alias("s"), "words")
    falls = F.coalesce((F.col("s") < F.lag("s").over(Window.partitionBy("doc_id").orderBy("chunk_id"))).cast("int"), F.lit(0))
    return c.withColumn("falls", falls).groupBy("doc_id").agg(F.sum("words").cast("long").alias("placed"), F.max(F.col("s") + F.col("words")).cast("long").alias("covered"), F.sum("falls").cast("long").alias("falls"))


def c7_neardup(spark, sf):
    """Pairs of passages and whole documents whose term sets overlap by 0.6 or more, by a prefix filter."""
    b = load(spark, sf, "benchmark").select(F.col("item_id").alias("id"), X.terms(F.col("text")).alias("tokens"))
    d = _docs(spark, sf).select((F.col("doc_id") + 1000000).alias("id"), X.terms(F.col("text")).alias("tokens"))
    return similarity.jaccard_pairs(b.union(d), 0.6)


def j11_inventory(spark, sf):
    tags = ["p", "h1", "li", "a", "script", "style"]
    counts = [F.regexp_count("html", F.lit(f"<{t}[ >]")).cast("long").alias(f"n_{t}") for t in tags]
    return load(spark, sf, "pages").select("page_id", *counts)


def b38_render(spark, sf):
    """A page's list items joined by blanks, and its headings."""
    items = F.transform(F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), F.lit(1)), lambda x: F.regexp_replace(x, "<[^>]*>", ""))
    heads = F.transform(F.regexp_extract_all("html", F.lit("<h1>(.*?)</h1>"), F.lit(1)), lambda x: F.regexp_replace(x, "<[^>]*>", ""))
    return load(spark, sf, "pages").select("page_id", F.array_join(items, " ").alias("items"), F.array_join(heads, " / ").alias("headings"))


_D = "with d as (select * from documents where text is not null)"
_TERMS = "list_filter(regexp_extract_all(lower({}), '[a-z]{{3,}}'), lambda w: w not in (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "))"
_CONTENT = "list_filter(regexp_extract_all(lower({}), '[a-z]+'), lambda w: len(w) > 1 and w not in (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "))"
_SPECIFIC = "list_filter(regexp_extract_all(lower({}), '[a-z]+'), lambda w: len(w) > 1 and w not in (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS + X.GENERIC) + "))"
_PASSAGES = "with p as (select item_id, b.text as span, d.text from benchmark b join documents d on doc_id = item_id where d.text is not null)"
_WORDS = "list_filter(regexp_split_to_array(text, '[ \\n\\t\\r\\f\\v]+'), lambda w: w <> '')"


def _windows_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"select doc_id, cast(s // {step} + 1 as bigint) as chunk_id, s, list_slice(w, s + 1, s + {size}) as c from (select doc_id, w, unnest(generate_series(0, len(w) - 1, {step})) as s from (select doc_id, {_WORDS} as w from d) where len(w) > 0)"


def _classes_sql() -> str:
    at = ["nullif(len(regexp_extract(text, '(?s)^(.*?)(?:" + p.replace("'", "''") + ")', 1)) + 1, case when regexp_matches(text, '" + p.replace("'", "''") + "') then -1 else len(regexp_extract(text, '(?s)^(.*?)(?:" + p.replace("'", "''") + ")', 1)) + 1 end)" for _, p in CLASSES]
    label = "case " + " ".join(f"when {a} > 0 then '{n}'" for (n, _), a in zip(CLASSES, at, strict=True)) + " else 'UNKNOWN' end"
    conf = "case " + " ".join(f"when {a} > 0 then case when {a} <= 1500 then 'HIGH' else 'MEDIUM' end" for a in at) + " else 'NONE' end"
    return f"{label} as label, {conf} as confidence"


_HITS = "len(list_filter(regexp_extract_all(lower({}), '[a-z0-9à-öø-ÿ]+'), lambda w: w in ({})))"
_TOPIC = " union all ".join(
    f"select doc_id, '{n}' as topic, 3.0::double * {_HITS.format('string_split(text, chr(10))[1]', _quoted)} + {_HITS.format('text', _quoted)} as score from d"
    for n, _quoted in ((n, ", ".join(f"'{x}'" for x in w)) for n, w in TOPICS.items())
)
_MATCH = "x = y or (len(x) >= 6 and len(y) >= 6 and x[1:5] = y[1:5]) or (len(x) >= 4 and len(y) >= 4 and (contains(x, y) or contains(y, x)))"
SQL = {
    "b14_clean": _D + " select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '(?m)^ *[0-9]+ *$', '', 'g'), '\\n{2,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as text from d",
    "b15_norm": _D + " select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '­ *', '', 'g'), '[​‌‍﻿]', '', 'g'), '-\\n', '', 'g'), '[^a-z0-9à-öø-ÿ]+', ' ', 'g'), ' ') as text from d",
    "b16_titles": _D + " select doc_id, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g'), ' ') as title, regexp_replace(lower(source || '_' || lang), '[^a-z0-9]+', '', 'g') as file from d",
    "b17_tags": "with b as (select page_id, html, trim(regexp_replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '&copy;', '©'), '[ \\n\\t]+', ' ', 'g'), ' ') as t from pages) select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, length(t) as chars, md5(t) as digest from b",
    "b18_tokens": _D + f" select doc_id, len({_WORDS}) as words, len({_TERMS.format('text')}) as terms, len({_CONTENT.format('text')}) as content, len({_SPECIFIC.format('text')}) as specific, len(regexp_extract_all(lower(text), '[a-z'']+')) as letters from d",
    "b20_classify": _D + f" select doc_id, {_classes_sql()} from d",
    "b21_license": _D + ", l as (select doc_id, lower(concat_ws(' ', case doc_id % 3 when 0 then 'Creative Commons BY' when 1 then 'https://creativecommons.org/licenses/by-nc/4.0' end, text)) as t from d) select doc_id, case when (contains(t, 'creative commons') or contains(t, 'cc0') or contains(t, 'cc-by') or contains(t, 'cc by') or contains(t, 'creativecommons')) then case when contains(t, '-nc') or contains(t, '-nd') or contains(t, 'noncommercial') or contains(t, 'noderiv') then 'RESTRICTED' else 'PERMISSIVE' end else 'UNKNOWN' end as category from l",
    "b22_authority": _D + ", n as (select doc_id, text, case doc_id % 5 when 0 then 'World Health Organization' when 1 then 'www.cdc.gov' when 2 then '' else source end as name from d), s as (select doc_id, name, lower(name || ' ' || text[1:2000]) as s from n), l as (select doc_id, case when contains(s, 'world health organization') then 'WHO' when contains(s, 'national institute on aging') then 'NIA' when contains(s, 'national institutes of health') then 'NIH' when contains(s, 'centers for disease control') then 'CDC' when contains(s, '.gov') or contains(s, 'government') then 'GOVERNMENT' when len(name) > 0 then 'OTHER' else 'UNKNOWN' end as authority from s) select doc_id, authority, case authority when 'WHO' then 1.0 when 'NIA' then 0.95 when 'NIH' then 0.95 when 'CDC' then 0.95 when 'GOVERNMENT' then 0.9 when 'OTHER' then 0.85 else 0.5 end::double as score from l",
    "b23_topic": _D + f", s as ({_TOPIC}), k as (select *, row_number() over (partition by doc_id order by score desc, topic) as k, max(score) over (partition by doc_id) as most from s) select doc_id, topic, score from k where score >= 2 or (most < 2 and k = 1 and score >= 1)",
    "b24_longest": _D + ", w as (select doc_id, unnest(s) as word, unnest(range(len(s))) as i from (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as s from d)) select d.doc_id, coalesce(word, '') as word from d left join (select doc_id, word from w qualify row_number() over (partition by doc_id order by len(word) desc, i) = 1) using (doc_id)",
    "b26_fuzzy": _PASSAGES + f", x as (select item_id, unnest({_TERMS.format('span')}) as x, list_distinct({_TERMS.format('text')}) as ys from p) select p.item_id, count(x.x) filter (len(list_filter(ys, lambda y: {_MATCH})) > 0) as matches from p left join x using (item_id) group by 1",
    "b27_span_cov": _PASSAGES + f", t as (select item_id, {_CONTENT.format('span')} as s, {_CONTENT.format('text')} as e from p) select item_id, case when len(s) = 0 then 1.0 else round(len(list_filter(s, lambda w: list_contains(e, w))) / len(s)::double, 4) end as coverage from t",
    "b28_jaccard": _PASSAGES + f", t as (select item_id, list_distinct({_TERMS.format('span')}) as s, list_distinct({_TERMS.format('text')}) as e from p) select item_id, case when len(s) + len(e) > 0 then round(len(list_intersect(s, e)) / len(list_distinct(list_concat(s, e)))::double, 6) else 0.0 end as jaccard from t",
    "b29_locate": _D + ", n as (select doc_id, text, string_split(text, chr(10))[-1] as needle from d) select doc_id, case when needle = '' then 1 else instr(text, needle) end as at, 'RAW' as how from n",
    "b30_screen": _D + ", r as (select case when length(text) < 200 then 'TOO_SHORT' when len(string_split(text, ' ')) < 20 then 'FEW_WORDS' when len(string_split(text, ' ')) > 5000 then 'TOO_LONG' when length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text)::double < 0.5 then 'FEW_LETTERS' when contains(text, '###') or contains(text, '%%%') then 'NOISE' when upper(text) = text then 'SHOUTING' when contains(text, '@') then 'HAS_ADDRESS' else 'PASS' end as reason from d) select reason, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 2) as pct from r group by 1",
    "b31_answer": "select conv_id, turn, trim(split_part(text, chr(10) || 'Sources:', 1)) as answer from conversations where text is not null",
    "b32_prompt": "with c as (select * from conversations where text is not null) select conv_id, string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) order by turn) as history, md5(max_by(text, turn) filter (role = 'user')) as question from c group by 1",
    "b33_strip": "with c as (select page_id, case when instr(html, '<nav>') > 0 and instr(html, '</nav>') > instr(html, '<nav>') then left(html, instr(html, '<nav>') - 1) || substr(html, instr(html, '</nav>') + 6) end as t from pages) select page_id, length(t) as chars, md5(t) as digest from c",
    "b36_lists": "select p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ', ,' || p_type || ' ,', ','), lambda x: trim(x)), lambda x: x <> ''), '|') as items from part",
    "b37_language": "select case when lower(trim(upper(lang))) in ('ko', 'en') then lower(lang) else 'en' end as language, count(*) as n from documents group by 1",
    "b39_filter": "select lang, source, count(*) as n, sum(n_chars)::bigint as chars from documents where lang in ('en', 'de') and n_chars >= 360 and source is not null group by all",
    "j8_chunks": _D + f", c as ({_windows_sql(180, 40)}) select doc_id, chunk_id, len(c) as words, md5(array_to_string(c, ' ')) as digest from c",
    "j10_sweep": _D + " " + " union all ".join(f"select cast({s} as integer) as size, cast({o} as integer) as overlap, count(*) as chunks, round(avg(len(c)), 4) as mean_words, max(len(c)) as most_words from ({_windows_sql(s, o)})" for s, o in [(120, 30), (180, 40), (250, 50)]),
    "e9_numbering": _D + f", c as ({_windows_sql(180, 40)}) select doc_id, 'doc' || lpad(cast(doc_id as varchar), 6, '0') || '__' || lpad(cast(chunk_id as varchar), 5, '0') as id, chunk_id from c",
    "d25_coverage": _D + f", c as ({_windows_sql(180, 40)}), f as (select *, coalesce(s < lag(s) over (partition by doc_id order by chunk_id), false) as fall from c) select doc_id, sum(len(c))::bigint as placed, max(s + len(c)) as covered, count(*) filter (fall) as falls from f group by 1",
    "c7_neardup": f"with t as (select item_id as id, list_distinct({_TERMS.format('text')}) as s from benchmark union all select doc_id + 1000000, list_distinct({_TERMS.format('text')}) from documents where text is not null), e as (select id, len(s) as n, unnest(s) as w from t), o as (select a.id as a, b.id as b, a.n as na, b.n as nb, count(*) as k from e a join e b on a.w = b.w and a.id < b.id and least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) group by all) select a, b, round(k / (na + nb - k)::double, 6) as jaccard from o where k / (na + nb - k)::double >= 0.6",
    "j11_inventory": "select page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{t}[ >]')) as n_{t}" for t in ["p", "h1", "li", "a", "script", "style"]) + " from pages",
    "b38_render": "select page_id, coalesce(array_to_string(list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')), ' '), '') as items, coalesce(array_to_string(list_transform(regexp_extract_all(html, '<h1>(.*?)</h1>', 1), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')), ' / '), '') as headings from pages",
}
_PLAIN = ["b19_sentences", "j9_structured"]
QUERIES = {name: globals()[name] for name in [*SQL, *_PLAIN]}
