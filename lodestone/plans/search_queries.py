"""Search, signal and text queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon, query as qy, text as tx
from ..operators import access, search as se
from ..streaming import ingest
from .catalog import register

NOW = "2024-01-28 12:00:00"
AT = f"TIMESTAMP '{NOW}'"


def docs(t):
    return t("s_index").select("id", "title", "content")


def words(t, *only):
    """Postings of a search's words."""
    return se.postings(t("s_index").select("id", "search_text"), "search_text", only)


# Tokens in SQL: lower-case, other signs to spaces, split, 2 to 40 signs, no stop words.
STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def tokens(column: str) -> str:
    # Folding of Arabic letters does not touch these tables' texts.
    return f"list_filter(regexp_split_to_array(regexp_replace(trim(regexp_replace(lower({column}), '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}\\s_-]', ' ', 'g'), '[\\s_-]+'), lambda x: length(x) BETWEEN 2 AND 40 AND x NOT IN ({STOP}))"


POST = f"p AS (SELECT token, id, COUNT(*) AS tf FROM (SELECT id, UNNEST({tokens('text')}) AS token FROM s_entries) GROUP BY 1, 2)"
register("search_postings", f"WITH {POST} SELECT token, COUNT(*) AS df, CAST(SUM(tf) AS BIGINT) AS tf FROM p GROUP BY 1", lambda t: se.postings(docs(t)).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")))
register("search_and", f"WITH {POST} SELECT id, 2 AS hits, CAST(SUM(tf) AS BIGINT) AS tf FROM p WHERE token IN ('und', 'sich') GROUP BY 1 HAVING COUNT(DISTINCT token) = 2", lambda t: se.retrieve(words(t, "und", "sich"), [["und"], ["sich"]]))
register("search_or", f"WITH {POST} SELECT id, CAST(COUNT(DISTINCT CASE WHEN token = 'sur' THEN 1 ELSE 2 END) AS INT) AS hits, CAST(SUM(tf) AS BIGINT) AS tf FROM p WHERE token = 'sur' OR starts_with(token, 'under') GROUP BY 1", lambda t: se.retrieve(words(t, "sur", "under*"), [["sur"], ["under*"]], "or"))
register("search_exclude", f"WITH {POST} SELECT id, 1 AS hits, CAST(SUM(tf) AS BIGINT) AS tf FROM p WHERE token = 'und' AND id NOT IN (SELECT id FROM p WHERE token = 'sich') GROUP BY 1", lambda t: se.retrieve(words(t, "und", "sich"), [["und"]], exclude=["sich"]))
STEPS = "(SELECT id, COUNT(DISTINCT token) AS hits, CAST(SUM(tf) AS BIGINT) AS tf, 0 AS step FROM p WHERE token IN ('sur', 'nosuchword') GROUP BY 1 HAVING COUNT(DISTINCT token) = 2 UNION ALL SELECT id, COUNT(DISTINCT token), CAST(SUM(tf) AS BIGINT), 1 FROM p WHERE token IN ('sur', 'und') GROUP BY 1 UNION ALL SELECT id, 1, tf, 2 FROM p WHERE token = 'erthat')"
register("search_relaxation", f"WITH {POST}, s AS {STEPS} SELECT id, CAST(hits AS INT) AS hits, tf, step FROM s WHERE step = (SELECT MIN(step) FROM s)", lambda t: se.relax(words(t, "sur", "nosuchword", "und", "erthat"), [([["sur"], ["nosuchword"]], "and"), ([["sur"], ["und"]], "or"), ([["erthat"]], "or")]))
register("search_relevance", f"WITH {POST}, d AS (SELECT token, COUNT(*) AS df FROM p WHERE token IN ('und', 'sur') GROUP BY 1) SELECT id, ROUND(SUM(tf * pow(log10((SELECT COUNT(*) FROM s_index)::DOUBLE / df), 2)), 6) AS score FROM p JOIN d USING (token) GROUP BY 1", lambda t: se.relevance(words(t, "und", "sur"), ["und", "sur"], t("s_index")))


def candidates(t):
    return t("s_index").withColumn("fulltext", F.col("id") % 10 / 10.0)


# Scores in SQL; the texts hold no sign that folding touches.
NORMAL = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


def rank_sql(words: list[str], phrase: str, rest: str = "0") -> str:
    parts = ["3 * fulltext", f"CASE WHEN contains(nt, '{phrase}') THEN 8 WHEN contains(nc, '{phrase}') THEN 3 ELSE 0 END"]
    for w in words:
        parts.append(f"CASE WHEN contains(nt, '{w}') THEN 2 WHEN contains(nc, '{w}') THEN 0.5 ELSE 0 END")
        if w.isdigit():
            parts.append(f"CASE WHEN contains(nt, '{w}') THEN 5 ELSE -1 END")
    parts.append(f"CASE WHEN strpos(nt, '{words[0]}') > 0 THEN 1.5::DOUBLE / (strpos(nt, '{words[0]}') + 1) ELSE 0 END")
    parts += ["ln(clicks + 1) * 2.5", "ln(views + 1) * 1.5", "popularity * 3", "ctr * 4", "freshness * 2", rest]
    return "ROUND(CAST(" + " + ".join(f"CAST({p} AS DOUBLE)" for p in parts) + " AS DOUBLE), 4)"


WITH_TEXT = f"SELECT *, {NORMAL.format('title')} AS nt, {NORMAL.format('content')} AS nc, {tokens('title || chr(32) || content')} AS toks FROM "
TASTE = "CASE WHEN data_type_slug IN ('products', 'product', 'items', 'goods') THEN 0.5 * 5 ELSE 0 END + CASE WHEN list_contains(toks, 'ersh') THEN 0.4 * 6 ELSE 0 END + CASE WHEN data_type_id = 1 THEN 0.6 * 2 ELSE 0 END + CASE WHEN contains(nt, 'zzz') THEN 0.9 * 2 WHEN contains(nt, 'an') THEN 0.7 * 2 ELSE 0 END"
register("search_rank", f"SELECT id, {rank_sql(['the', '7'], 'of the', TASTE)} AS score FROM ({WITH_TEXT} (SELECT *, id % 10 / 10.0::DOUBLE AS fulltext FROM s_index))", lambda t: se.rerank(candidates(t), ["the", "7"], "of the", "buy", 0.5, terms={"ersh": 0.4}, types={1: 0.6}, recent=[("zzz", 0.9), ("an", 0.7)]).select("id", "score"))
register("index_features", "SELECT id, regexp_matches(title, '[0-9]') AS has_numbers, CAST(len(string_split_regex(trim(title), ' +')) AS INT) AS word_count, CAST(length(title) AS INT) AS title_length, lower(string_split(trim(title), ' ')[1]) AS primary_keyword FROM s_index", lambda t: se.index(docs(t)).drop("title", "content"))
register("snippet", "SELECT id, CASE WHEN strpos(lower(text), 'of the') > 0 THEN substring(text, GREATEST(strpos(lower(text), 'of the') - 60, 1), 160) ELSE substring(text, 1, 160) END AS snippet FROM s_entries", lambda t: t("s_entries").select("id", se.snippet(F.col("text"), "of the").alias("snippet")))
register("highlight", "SELECT p_partkey AS id, regexp_replace(regexp_replace(p_name, '(widget)', '**\\1**', 'gi'), '(ring)', '**\\1**', 'gi') AS name FROM part", lambda t: t("parts").select(F.col("p_partkey").alias("id"), se.highlight(F.col("p_name"), ["ring", "widget"]).alias("name")))
register("compare_results", f"WITH {POST}, a AS (SELECT id FROM p WHERE token IN ('und', 'sich') GROUP BY 1 HAVING COUNT(DISTINCT token) = 2), b AS (SELECT DISTINCT id FROM p WHERE token IN ('sich', 'sur')) SELECT CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'lost' ELSE 'common' END AS state, COUNT(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1", lambda t: se.compare(se.retrieve(words(t, "und", "sich"), [["und"], ["sich"]]), se.retrieve(words(t, "sich", "sur"), [["sich"], ["sur"]], "or")).groupBy("state").agg(F.count(F.lit(1)).alias("n")))

# The whole search
ASK = se.Search("und sich without nicht", 1, "de", 1, 10)
OPEN = "project_id = 1 AND language = '{0}' AND status = 'published'"


def found(t, ask=ASK):
    index = t("s_index")
    return index, se.postings(index, "search_text"), ask


register("search_filter", f"SELECT id FROM s_index WHERE {OPEN.format('en')} AND NOT contains(search_text, 'nicht') AND (data_type_slug IS NULL OR data_type_slug IN ('products', 'product', 'items', 'goods')) UNION ALL SELECT id FROM s_index WHERE {OPEN.format('fr')} AND data_type_slug = 'articles'", lambda t: se.eligible(t("s_index"), se.Search("", 1, "en"), "buy", 0.5, ["nicht"]).unionByName(se.eligible(t("s_index"), se.Search("", 1, "fr", type_slug="articles"), "buy", 0.9)).select("id"))
register("search_exclude_only", f"WITH o AS (SELECT * FROM s_index WHERE {OPEN.format('de')} AND NOT contains(search_text, 'nicht')), top AS (SELECT * FROM o ORDER BY popularity DESC, published_at DESC, id LIMIT 100) SELECT id, ROUND(CAST(3 * popularity + ln(clicks + 1) * 2.5 + ln(views + 1) * 1.5 + popularity * 3 + ctr * 4 + freshness * 2 AS DOUBLE), 4) AS score, (SELECT COUNT(*) FROM o) AS total FROM top ORDER BY score DESC, id LIMIT 10 OFFSET 10", lambda t: se.search(t("s_index"), se.postings(t("s_index"), "search_text"), se.Search("", 1, "de", 2, 10), qy.process(""), ["nicht"]).select("id", "score", "total"))
TOK = f"tk AS (SELECT token, id, COUNT(*) AS tf FROM (SELECT id, UNNEST({tokens('search_text')}) AS token FROM s_index) GROUP BY 1, 2)"
WHOLE = f"""WITH {TOK}, o AS (SELECT * FROM s_index WHERE {OPEN.format('de')} AND NOT contains(search_text, 'nicht')), h AS (SELECT id, BOOL_OR(starts_with(token, 'und')) AS a, BOOL_OR(starts_with(token, 'sich')) AS b FROM tk WHERE starts_with(token, 'und') OR starts_with(token, 'sich') GROUP BY 1), m AS (SELECT id, CASE WHEN a AND b THEN 0 WHEN a THEN 1 ELSE 2 END AS step FROM h WHERE id IN (SELECT id FROM o)), d AS (SELECT token, COUNT(*) AS df FROM tk WHERE token IN ('und', 'sich') GROUP BY 1), f AS (SELECT id, ROUND(SUM(tf * pow(log10((SELECT COUNT(*) FROM s_index)::DOUBLE / df), 2)), 6) AS fulltext FROM tk JOIN d USING (token) GROUP BY 1), hit AS (SELECT o.*, step FROM o JOIN m USING (id) WHERE step = (SELECT MIN(step) FROM m)), top AS (SELECT hit.*, COALESCE(fulltext, 0) AS fulltext FROM hit LEFT JOIN f USING (id) ORDER BY COALESCE(fulltext, 0) DESC, id LIMIT 100) SELECT id, step, {rank_sql(['und', 'sich'], 'und sich')} AS score, (SELECT COUNT(*) FROM hit) AS total FROM ({WITH_TEXT} top) ORDER BY score DESC, id LIMIT 10"""
register("search_whole", WHOLE, lambda t: se.search(*found(t), qy.process("und sich"), ["nicht"]).select("id", "step", "score", "total"))
register("search_answer", WHOLE, lambda t: se.answer(*found(t)).items.select("id", "step", "score", "total"))
register("search_log", "SELECT keyword, COUNT(*) AS n, CAST(SUM(results_count) AS BIGINT) AS results FROM (SELECT keyword, results_count FROM s_searches UNION ALL SELECT 'zzqq', 0) GROUP BY 1", lambda t: se.log_search(t("s_searches"), se.answer(*found(t, se.Search("zzqq", 1, "de"))), se.Search("zzqq", 1, "de"), None, NOW).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.sum("results_count").alias("results")))

# Queries as typed: what the driver's functions make of each, as JSON.


def typed(name: str, function, cases: dict[str, str]) -> None:
    """A query over all customers, each with one of the cases by its key, and what the case has to give."""
    asked, given = list(cases), [cases[k].replace("'", "''") for k in cases]
    pick = lambda: F.element_at(F.array(*map(F.lit, asked)), (F.col("c_custkey") % len(asked) + 1).cast("int"))
    sql = "CASE c_custkey % " + str(len(asked)) + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(given)) + " END"
    register(name, f"SELECT c_custkey AS id, {sql} AS result FROM customer", lambda t: t("customers").select(F.col("c_custkey").alias("id"), qy.as_column(pick(), function).alias("result")))


def rewritten(function):
    return lambda text: [(r := function(text)).text, r.exclude, r.negated]


typed("query_english", rewritten(qy.rewrite_english), {
    "iphone not 14": '["iphone",["14"],true]', "not iphone 14": '["iphone",["14"],true]', "Without samsung": '["",["samsung"],true]', "laptop excluding dell": '["laptop",["dell"],true]',
    "notable book": '["notable book",[],false]', "show me cheap phones, not including the samsung-galaxy a b c": '["cheap phones",["samsung","galaxy"],true]', "no 14 15": '["",["14","15"],true]', "": '["",[],false]',
})
typed("query_arabic", rewritten(qy.rewrite_arabic), {
    "ما بدي ايفون 14": '["ايفون",["14"],true]', "آيفون بدون كفر": '["ايفون",["كفر","case","cover"],true]', "بدون سامسونج": '["",["سامسونج","samsung"],true]', "أريد أيفون": '["ايفون",[],false]', "هاتف غير ١٥": '["هاتف",["15"],true]',
})
typed("query_groups", lambda text: [(p := qy.process(text)).words, [qy.render(s, ["x+"]) for s in p.steps], p.intent, p.confidence], {
    "the best phone": '[["phone"],["phone* (mobile* cellphone* جوال* هاتف*) -x"],"general",0.0]',
    "red shoes": '[["red","shoes"],["+red* +shoes* -x","+red* shoes* -x","red* shoes* -x","red* -x"],"general",0.0]',
    "the of": '[["the","of"],["+the* +of* -x","+the* of* -x","the* of* -x","the* -x"],"general",0.0]',
    "repair screen": '[["repair","screen"],["+(repair* صيانه* تصليح*) +(screen* شاشه*) -x","+(repair* صيانه* تصليح*) screen* (شاشه*) -x","repair* (صيانه* تصليح*) screen* (شاشه*) -x","repair* (صيانه* تصليح*) -x"],"repair",1.0]',
    "ايفون": '[["ايفون"],["ايفون* (ابل* \\"هاتف ذكي\\" iphone*) -x"],"general",0.0]', "": '[[],["-x"],"general",0.0]',
})
typed("query_layout", lambda text: [(x := qy.fix_layout(text)).fixed, x.confidence, x.direction, qy.mistyped_arabic(text).fixed], {
    "هحاخىث": '["iphone",1.0,"ar_to_en","iphone"]', "kfdghj": '["نبيلات",1.0,"en_to_ar",null]', "iphone": "[null,0.0,null,null]", "iphone سعر جديد": "[null,0.0,null,null]", "12 34": "[null,0.0,null,null]",
})
typed("query_typos", lambda text: list(qy.correct(text)), {
    "iphoen case": '["iphone case",0.975]', "Samsong galxy": '["samsung galaxy",0.95]', "laptop": "[null,0.0]", "compuetr": '["computer",0.72]', "tv xx": "[null,0.0]", "keybord": '["keyboard",0.88]',
})
typed("query_entities", qy.entities, {
    "Samsung s24 ultra black 256gb in Dubai under 500": '{"brand":"samsung","model":"s24 ultra","product":"samsung s24 ultra","place":"dubai","price_min":null,"price_max":500.0,"attributes":{"color":"black","storage":"256GB"}}',
    "15 pro max near Lyon 200 to 500": '{"brand":null,"model":"15 pro max","product":"15 pro max","place":"lyon","price_min":200.0,"price_max":500.0,"attributes":{}}',
    "red apple $100": '{"brand":"apple","model":null,"product":"apple","place":null,"price_min":80.0,"price_max":120.0,"attributes":{"color":"red"}}',
})

# Logs
KEY = "lower(trim(keyword))"
AGO = "COUNT(*) FILTER (WHERE searched_at >= " + AT + " - to_hours({0}))"
POPULAR = f"SELECT keyword, language, count_24h, count_7d, count_30d, count_all, last_searched_at, 0 AS clicks, ROUND((4.0::DOUBLE * count_24h + 2.0::DOUBLE * count_7d + count_30d) / pow(GREATEST(date_sub('hour', last_searched_at, {AT}), 0) + 2.0, 1.5), 4) AS trending_score, ROUND(log10(count_all + 1) + GREATEST(0.0::DOUBLE, 1 - GREATEST(date_sub('day', last_searched_at, {AT}), 0) / 90.0::DOUBLE), 4) AS alltime_score, CASE WHEN count_7d <= 0 AND count_24h > 0 THEN 'rising' WHEN count_7d <= 0 THEN 'stable' WHEN count_24h >= 2 * (count_7d / 7.0::DOUBLE) THEN 'rising' WHEN count_24h <= 0.5::DOUBLE * (count_7d / 7.0::DOUBLE) THEN 'falling' ELSE 'stable' END AS trend FROM (SELECT {KEY} AS keyword, language, {AGO.format(24)} AS count_24h, {AGO.format(168)} AS count_7d, {AGO.format(720)} AS count_30d, COUNT(*) AS count_all, MAX(searched_at) AS last_searched_at FROM s_searches WHERE searched_at <= {AT} AND strlen(trim(keyword)) >= 2 GROUP BY 1, 2)"


def past(t):
    return t("s_searches").where(F.col("searched_at") <= F.lit(NOW).cast("timestamp_ntz"))


register("popular_recompute", POPULAR, lambda t: se.popular(past(t), NOW))
register("trending_topk", f"SELECT keyword, language, count_24h AS count, trending_score, trend FROM ({POPULAR}) ORDER BY trending_score DESC, count_24h DESC, count_all DESC, keyword, language LIMIT 10", lambda t: se.trending(se.popular(past(t), NOW), 10))
register("popular_topk", f"SELECT keyword, language, count_7d AS count, alltime_score, '7d' AS \"window\" FROM ({POPULAR}) ORDER BY alltime_score DESC, count_7d DESC, count_all DESC, keyword, language LIMIT 10", lambda t: se.most_popular(se.popular(past(t), NOW), 10, "7d"))
register("popular_fallback", f"SELECT keyword, language, count_all AS count, alltime_score, 'all' AS \"window\" FROM (SELECT * FROM ({POPULAR}) ORDER BY keyword, language LIMIT 2)", lambda t: se.most_popular(se.popular(past(t), NOW).orderBy("keyword", "language").limit(2), 10, "24h"))
register("trend_label", f"SELECT trend, COUNT(*) AS n FROM ({POPULAR}) GROUP BY 1", lambda t: se.popular(past(t), NOW).groupBy("trend").agg(F.count(F.lit(1)).alias("n")))
SUGGEST = f"SELECT project_id, keyword, language, search_count, last_searched_at, CAST(0 AS BIGINT) AS click_count, ROUND(log10(search_count + 1), 4) AS score FROM (SELECT project_id, {KEY} AS keyword, language, COUNT(*) AS search_count, MAX(searched_at) AS last_searched_at FROM s_searches WHERE length(trim(keyword)) >= 2 GROUP BY 1, 2, 3)"
register("suggestion_build", SUGGEST, lambda t: se.suggestions(t("s_searches")))
register("suggestion_score", f"SELECT project_id, keyword, language, ROUND(log10(search_count + 1) + 2 * log10(1) + GREATEST(0.0::DOUBLE, 1 - GREATEST(date_sub('day', last_searched_at, {AT}), 0) / 30.0::DOUBLE), 4) AS score FROM ({SUGGEST})", lambda t: se.rescored(se.suggestions(t("s_searches")), NOW).select("project_id", "keyword", "language", "score"))
register("suggest_prefix", f"SELECT * FROM ({SUGGEST}) WHERE starts_with(keyword, 'red') ORDER BY score DESC, search_count DESC, keyword, language LIMIT 10", lambda t: se.suggest(se.suggestions(t("s_searches")), "Red", 10))
PAIRS = f"""WITH k AS (SELECT keyword, list_sort(list_distinct({tokens('keyword')})) AS t FROM (SELECT {KEY} AS keyword FROM s_searches WHERE length(trim(keyword)) >= 3 AND searched_at >= {AT} - to_days(20) GROUP BY 1 HAVING COUNT(*) >= 2)), w AS (SELECT keyword, UNNEST(t) AS w FROM k), f AS (SELECT w, COUNT(*) AS f FROM w GROUP BY 1), b AS (SELECT x.w AS a, y.w AS b, COUNT(*) AS together FROM w x JOIN w y ON x.keyword = y.keyword AND x.w < y.w GROUP BY 1, 2 HAVING COUNT(*) >= 2), j AS (SELECT a, b, together, fa.f AS count_a, fb.f AS count_b, together::DOUBLE / (fa.f + fb.f - together) AS j, MAX(together) OVER () AS top FROM b JOIN f fa ON fa.w = a JOIN f fb ON fb.w = b) SELECT a, b, together, count_a, count_b, ROUND(j, 6) AS jaccard, ROUND(0.5::DOUBLE * j + 0.3::DOUBLE * (ln(together + 1) / ln(top + 1)) + 0.2::DOUBLE * (LEAST(count_a, count_b)::DOUBLE / GREATEST(count_a, count_b)), 6) AS confidence FROM j WHERE j >= 0.02"""
register("synonym_pairs", f"SELECT * FROM ({PAIRS}) WHERE confidence >= 0.2", lambda t: se.synonym_pairs(t("s_searches"), NOW, days=20, least_jaccard=0.02))
register("learned_synonyms", f"WITH q AS (SELECT * FROM ({PAIRS}) WHERE confidence >= 0.3), b AS (SELECT a AS word, b AS synonym, confidence FROM q UNION ALL SELECT b, a, confidence FROM q) SELECT word, synonym, confidence, CAST(rank AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY word ORDER BY confidence DESC, synonym) AS rank FROM b) WHERE rank <= 3", lambda t: se.learned_synonyms(se.synonym_pairs(t("s_searches"), NOW, days=20, least_jaccard=0.02), 0.3))
register("ctr_signals", f"SELECT id, ctr, freshness, ROUND(0.6::DOUBLE * ln(clicks + 1) + 0.3::DOUBLE * ln(views + 1) + 0.1::DOUBLE * freshness, 4) AS popularity FROM (SELECT id, clicks, views, CAST((clicks * 20000 + views + 1) // ((views + 1) * 2) AS DOUBLE) / 10000 AS ctr, CASE WHEN d <> -1 THEN ROUND(1::DOUBLE / (d + 1), 4) END AS freshness FROM (SELECT *, DATE '2024-01-28' - CAST(published_at AS DATE) AS d FROM s_entries))", lambda t: se.signals(t("s_entries"), NOW).select("id", "ctr", "freshness", "popularity"))
register("popularity_rating", "SELECT x.id, ROUND(2 * log10(e.ratings_count + 1) + 1.5::DOUBLE * log10(x.clicks + 1) + 0.5::DOUBLE * CAST(e.ratings_avg AS DOUBLE), 4) AS popularity_rating FROM s_index x LEFT JOIN (SELECT * FROM s_entries WHERE id % 4 > 0) e ON e.id = x.entry_id", lambda t: se.rating_popularity(t("s_index"), t("s_entries").where("id % 4 > 0")).select("id", "popularity_rating"))
register("user_type_affinity", "SELECT user_id, type, COUNT(*) AS n, ROUND(COUNT(*)::DOUBLE / (COUNT(*) + 3), 4) AS affinity FROM s_clicks GROUP BY 1, 2 HAVING COUNT(*) >= 2", lambda t: se.type_affinity(t("s_clicks")))
TERMS = f"SELECT user_id, UNNEST(list_distinct({tokens('text')})) AS term FROM s_clicks"
register("user_term_affinity", f"SELECT user_id, term, n, ROUND(n::DOUBLE / (n + 2), 4) AS affinity FROM (SELECT user_id, term, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, term) AS r FROM ({TERMS}) GROUP BY 1, 2 HAVING COUNT(*) >= 2) WHERE r <= 20", lambda t: se.term_affinity(t("s_clicks")))
register("recent_keywords", f"WITH l AS (SELECT user_id, keyword, MAX(searched_at) AS seen FROM s_searches WHERE searched_at >= {AT} - to_days(14) AND length(trim(keyword)) >= 2 GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY seen DESC, keyword) AS r FROM l), w AS (SELECT user_id, UNNEST(regexp_split_to_array(lower(trim(keyword)), '\\s+')) AS word, ROUND(exp(-GREATEST(date_sub('day', seen, {AT}), 0) / 7.0::DOUBLE), 4) AS weight FROM r WHERE r <= 8), m AS (SELECT user_id, word, MAX(weight) AS weight FROM w WHERE length(word) >= 3 AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY 1, 2) SELECT user_id, word, weight FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY weight DESC, word) AS r FROM m) WHERE r <= 10", lambda t: se.recent_keywords(t("s_searches"), NOW))
LAST = f"(SELECT * FROM s_searches WHERE searched_at >= {AT} - to_days(7))"


def half_up(n: str, d: str, digits: int) -> str:
    scale = 10**digits
    return f"CASE WHEN ({d}) > 0 THEN CAST(({n}) * {2 * scale} + ({d}) AS BIGINT) // (({d}) * 2) / CAST({scale} AS DOUBLE) ELSE 0.0 END"


register("query_overview", f"SELECT *, {half_up('zero * 100', 'searches', 1)} AS zero_rate FROM (SELECT COUNT(*) AS searches, COUNT(*) FILTER (WHERE results_count = 0) AS zero, {half_up('SUM(results_count)', 'COUNT(*)', 2)} AS avg_results, COUNT(DISTINCT keyword) AS keywords FROM {LAST})", lambda t: se.quality_overview(t("s_searches"), NOW))
MEANS = f"COUNT(*) AS n, {half_up('SUM(results_count)', 'COUNT(*)', 4)} AS avg_results, {half_up('SUM(CAST(ROUND(intent_confidence * 1000) AS BIGINT))', 'COUNT(*) * 1000', 4)} AS avg_confidence"


def kind(name: str, where: str, least: int, most: int) -> str:
    return f"(SELECT '{name}' AS kind, keyword, language, {MEANS} FROM {LAST} WHERE {where} GROUP BY 2, 3 HAVING COUNT(*) >= {least} ORDER BY n DESC, keyword, language LIMIT {most})"


register("query_problems", " UNION ALL ".join((kind("zero", "results_count = 0", 2, 20), kind("low", "results_count > 0 AND results_count < 3", 2, 20), kind("unsure", "intent_confidence < 0.4 AND results_count > 0", 3, 15), kind("suspicious", "length(keyword) > 100 OR contains(keyword, '+++')", 1, 10))), lambda t: se.quality_problems(t("s_searches"), NOW))
register("search_logs", "SELECT id, keyword, (SELECT COUNT(*) FROM s_searches WHERE results_count = 0) AS total FROM s_searches WHERE results_count = 0 ORDER BY searched_at DESC, id LIMIT 20 OFFSET 20", lambda t: se.log_page(t("s_searches"), "zero_results", 2, 20).select("id", "keyword", "total"))
register("search_logs_frequent", f"WITH g AS (SELECT keyword, language, project_id, COUNT(*) AS search_count, {half_up('SUM(results_count)', 'COUNT(*)', 4)} AS avg_results, MAX(searched_at) AS last_searched FROM s_searches GROUP BY 1, 2, 3) SELECT *, (SELECT COUNT(*) FROM g) AS total FROM g ORDER BY search_count DESC, keyword, language, project_id LIMIT 20", lambda t: se.log_page(t("s_searches"), "high_frequency", 1, 20))
register("clicked_texts", f"WITH r AS (SELECT c.user_id, c.id AS click_id, clicked_at, x.language, trim(concat_ws(' ', CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(content) <> '' THEN content END)) AS text FROM s_clicks c LEFT JOIN s_searches s ON s.id = c.search_log_id JOIN s_index x ON x.entry_id = c.entry_id WHERE clicked_at >= {AT} - to_days(30) AND (s.language IS NULL OR x.language = s.language)), o AS (SELECT user_id, click_id, clicked_at, arg_min(text, language) AS text FROM r WHERE text <> '' GROUP BY 1, 2, 3) SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY clicked_at DESC, click_id) AS INT) AS rank FROM o) WHERE rank <= 5", lambda t: se.clicked_texts(t("s_clicks"), t("s_searches"), t("s_index"), NOW, most=5))
register("click_counts_by_type", f"SELECT user_id, type, COUNT(*) AS clicks FROM s_clicks WHERE clicked_at >= {AT} - to_days(7) GROUP BY 1, 2", lambda t: se.click_counts(t("s_clicks"), NOW, 7))
FOUR = "CAST(SUM(CAST(ROUND({0} * 10000) AS BIGINT)) * 20000 + COUNT(*) * 10000 AS BIGINT) // (COUNT(*) * 20000) / CAST(10000 AS DOUBLE) AS avg_{0}"
register("signal_health", f"SELECT COUNT(*) AS rows, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(views) AS BIGINT) AS views, {FOUR.format('ctr')}, {FOUR.format('popularity')}, {FOUR.format('freshness')}, COUNT(*) FILTER (WHERE views = 0) AS zero_views, COUNT(*) FILTER (WHERE clicks = 0) AS zero_clicks FROM s_index", lambda t: se.signal_health(t("s_index")))
register("most_clicked", "SELECT entry_id, substring(title, 1, 30) AS title, clicks, views, ctr, popularity FROM s_index ORDER BY clicks DESC, entry_id LIMIT 5", lambda t: se.most_clicked(t("s_index")))

# Text
register("normalize_text", "SELECT id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS text FROM s_entries", lambda t: t("s_entries").select("id", tx.normalize(F.col("text")).alias("text")))
register("tokenize", f"SELECT id, CAST(len(list_distinct({tokens('text')})) AS INT) AS n FROM s_entries", lambda t: t("s_entries").select("id", F.size(tx.keywords(F.col("text"))).alias("n")))
register("strip_tags", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages", lambda t: t("web_pages").select("page_id", tx.strip_html(F.col("html")).alias("text")))
TYPED = "substring(w, 1, 1 + id % 3) || substring(w, 3 + id % 3)"
WORDS = "SELECT id, UNNEST(string_split(content, ' ')) AS w FROM s_index"
NEAR = "SELECT DISTINCT {0} AS word FROM ({1}) WHERE length(w) >= 5 AND regexp_matches(w, '^[a-z]+$') AND starts_with(w, 'thh')"
register("typo_correct", f"WITH q AS ({NEAR.format(TYPED, WORDS)}), d AS (SELECT word AS term FROM ({NEAR.format('w', WORDS)})), m AS (SELECT word, term, levenshtein(word, term) AS d FROM q, d WHERE levenshtein(word, term) <= CASE WHEN length(word) <= 5 THEN 1 WHEN length(word) <= 8 THEN 2 ELSE 3 END AND 1 - levenshtein(word, term)::DOUBLE / GREATEST(length(word), length(term)) >= 0.6), b AS (SELECT word, MIN(lpad(d::VARCHAR, 3, '0') || term) AS x FROM m GROUP BY 1) SELECT word, substring(x, 4) AS term, CAST(substring(x, 1, 3) AS INT) AS distance, CASE CAST(substring(x, 1, 3) AS INT) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.88::DOUBLE WHEN 2 THEN 0.72::DOUBLE ELSE 0.55::DOUBLE END AS confidence FROM b", lambda t: (lambda w: tx.typo_candidates(w.select(F.concat(F.substring(F.col("w"), F.lit(1), (F.col("id") % 3 + 1).cast("int")), F.substr(F.col("w"), (F.col("id") % 3 + 3).cast("int"))).alias("word")), w.select(F.col("w").alias("term"))).withColumn("confidence", F.col("confidence").cast("double")))(t("s_index").select("id", F.explode(F.split("content", " ")).alias("w")).where((F.length("w") >= 5) & F.col("w").rlike("^[a-z]+$") & F.col("w").startswith("thh"))))
register("intent_detect", "WITH s(intent, place, word, weight) AS (VALUES " + ", ".join(f"('{i}', {n}, '{w}', {x}::DOUBLE)" for n, (i, ws) in enumerate(lexicon.INTENTS.items()) for w, x in ws.items()) + "), q AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'buy cheap phone' WHEN 1 THEN 'how to fix a phone' WHEN 2 THEN 'a vs b best' WHEN 3 THEN 'learn what to buy' ELSE 'phone' END AS text FROM customer), w AS (SELECT id, UNNEST(string_split(lower(text), ' ')) AS word FROM q), m AS (SELECT id, intent, place, SUM(weight) AS w FROM w JOIN s USING (word) GROUP BY 1, 2, 3), b AS (SELECT id, arg_max(intent, w * 10 - place) AS intent, ROUND(MAX(w) / SUM(w), 4) AS confidence FROM m GROUP BY 1) SELECT q.id, CASE WHEN COALESCE(confidence >= 0.3, FALSE) THEN intent ELSE 'general' END AS intent, COALESCE(confidence, 0.0::DOUBLE) AS confidence FROM q LEFT JOIN b USING (id)", lambda t: tx.intent(t("customers").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "buy cheap phone").when(F.col("c_custkey") % 5 == 1, "how to fix a phone").when(F.col("c_custkey") % 5 == 2, "a vs b best").when(F.col("c_custkey") % 5 == 3, "learn what to buy").otherwise("phone").alias("text"))))
LETTERS = "regexp_replace(lower(text), '[^a-z]', '', 'g')"
COUNTS = f"SELECT *, length(l) AS nl, length(regexp_replace(l, '[^aeiou]', '', 'g')) AS nv, length(regexp_replace(s, '[^\u0600-\u06ff]', '', 'g')) AS na, length(s) AS ns FROM (SELECT id, text, {LETTERS} AS l, regexp_replace(text, '\\s+', '', 'g') AS s FROM s_entries)"
REPEATS = "len(list_filter(range(2, nl // 3 + 1), lambda n: nl - length(replace(l, substring(l, 1, n), '')) >= 3 * n AND (nl - length(replace(l, substring(l, 1, n), '')))::DOUBLE / nl >= 0.7)) > 0"
GIBBERISH = f"CASE WHEN nl < 4 OR na::DOUBLE / GREATEST(ns, 1) > 0.3 THEN FALSE WHEN nv::DOUBLE / nl < 0.1 THEN TRUE WHEN regexp_matches(l, '[^aeiou]{{5,}}') THEN TRUE WHEN nl < 6 THEN FALSE ELSE {REPEATS} END"
register("language_analysis", f"SELECT id, na::DOUBLE / GREATEST(ns, 1) > 0.3 AS is_arabic, NOT na::DOUBLE / GREATEST(ns, 1) > 0.3 AND na::DOUBLE / GREATEST(ns, 1) > 0.15 AS is_mixed, NOT na::DOUBLE / GREATEST(ns, 1) > 0.15 AS is_english_only, {GIBBERISH} AS is_gibberish, nv::DOUBLE / GREATEST(nl, 1) AS vowel_ratio, ROUND(na::DOUBLE / GREATEST(ns, 1), 4) AS arabic_ratio FROM ({COUNTS})", lambda t: t("s_entries").select("id", *[x.alias(n) for n, x in tx.language_analysis(F.col("text")).items()]))
LATIN = "length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))"
register("language_class", f"SELECT CASE WHEN na::DOUBLE / GREATEST(na + {LATIN}, 1) > 0.15 AND {LATIN}::DOUBLE / GREATEST(na + {LATIN}, 1) > 0.15 THEN 'mixed' WHEN na::DOUBLE / GREATEST(na + {LATIN}, 1) > 0.3 THEN 'arabic' WHEN {GIBBERISH} THEN 'gibberish' WHEN {LATIN} > 0 THEN 'latin' ELSE 'none' END AS class, COUNT(*) AS n FROM ({COUNTS}) GROUP BY 1", lambda t: t("s_entries").groupBy(tx.language_class(F.col("text")).alias("class")).agg(F.count(F.lit(1)).alias("n")))
register("word_tokens", "SELECT id, CAST(len(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2))) AS INT) AS n FROM s_index", lambda t: t("s_index").select("id", F.size(tx.tokens(F.col("title"))).alias("n")))
HOLDS = "SELECT user_id, feature FROM s_subscriptions JOIN s_plan_features USING (plan_id) WHERE status = 'active'"
register("visibility_filter", f"WITH held AS ({HOLDS} AND user_id = 7), r AS (SELECT p_partkey AS entry_id, CONCAT('feature', CAST(p_size % 8 AS VARCHAR)) AS feature FROM part WHERE p_partkey % 3 = 0) SELECT id FROM s_entries e WHERE id NOT IN (SELECT entry_id FROM r) OR EXISTS (SELECT 1 FROM r JOIN held USING (feature) WHERE r.entry_id = e.id)", lambda t: access.visible_to(t("s_entries").select("id"), t("parts").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("entry_id"), F.concat(F.lit("feature"), (F.col("p_size") % 8).cast("string")).alias("feature")), t("s_subscriptions").where("status = 'active'").join(t("s_plan_features"), "plan_id").select("user_id", "feature"), 7))

# Events (windows are an extension)
register("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2", lambda t: ingest.windowed_counts(t("event_log"), "ts", "1 hour"))
register("event_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts >= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 6 HOUR AS \"end\", COUNT(*) AS n FROM s GROUP BY user_id, k", lambda t: ingest.sessions(t("event_log"), "ts", "6 hours"))
