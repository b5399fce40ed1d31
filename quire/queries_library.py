"""Queries on chapters made of pages and on the reading desk.

``pages`` stand for chapters, ``events`` for annotations, edits and logs, ``orders`` for tasks, ``conversations`` for
messages and blocks, ``part`` for books and files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import patterns as P
from quire.functions import text as X
from quire.operators import chapters as C
from quire.operators import desk as K
from quire.operators import documents as D
from quire.queries_documents import _HAN2, _HOST, _LOWER, book_of, sql_literal, sql_marked, sql_visible
from quire.register import filer
from quire.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
query = filer(QUERIES, ORACLES)


def _md5(c: Column | str) -> Column:
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# Pages in four shapes: as they are, with a main element, with an unclosed body, and as a bare fragment.
_SHAPES = """v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN replace(replace(html, '<article>', '<main class="x">'), '</article>', '</main>')
  WHEN 2 THEN replace(html, '</body>', '') ELSE regexp_extract(html, '(?s)<article>(.*?)</article>', 1) END AS x FROM pages)"""


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    html, case = F.col("html"), F.col("page_id") % 4
    main = F.replace(F.replace(html, F.lit("<article>"), F.lit('<main class="x">')), F.lit("</article>"), F.lit("</main>"))
    x = F.when(case == 0, html).when(case == 1, main).when(case == 2, F.replace(html, F.lit("</body>"), F.lit(""))).otherwise(F.regexp_extract(html, "(?s)<article>(.*?)</article>", 1))
    return table(spark, sf_dir, "pages").select("page_id", x.alias("html"))


_CONTENT = """ data-content data-chapter-id="' || ch || '">"""


@query(f"""WITH {_SHAPES}, o AS (SELECT page_id, x, 'c' || page_id AS ch, regexp_extract(x, {sql_literal(P.MAIN_OPEN)}) AS mo, regexp_extract(x, {sql_literal(P.BODY_OPEN)}) AS bo FROM v),
p AS (SELECT *, CASE WHEN mo <> '' THEN mo ELSE bo END AS op FROM o), t AS (SELECT *, substr(x, 1, instr(x, op) - 1) AS head, substr(x, instr(x, op) + length(op)) AS tail FROM p),
c AS (SELECT *, regexp_extract(tail, CASE WHEN mo <> '' THEN {sql_literal(P.MAIN_CLOSE)} ELSE {sql_literal(P.BODY_CLOSE)} END) AS cl FROM t),
i AS (SELECT *, CASE WHEN op = '' THEN x WHEN cl <> '' THEN substr(tail, 1, instr(tail, cl) - 1) END AS inside, substr(tail, instr(tail, cl)) AS rest FROM c),
d AS (SELECT *, {sql_marked('inside', 'ch')} AS m FROM i),
f AS (SELECT page_id, CASE WHEN mo <> '' AND cl = '' THEN 'unclosed-main' WHEN mo = '' AND bo <> '' AND cl = '' THEN 'unclosed-body' END AS error,
  CASE WHEN mo <> '' THEN head || substr(mo, 1, length(mo) - 1) || '{_CONTENT}' || m || rest WHEN bo <> '' THEN head || bo || '<main{_CONTENT}' || m || '</main>' || rest
  ELSE '<!doctype html><html><head><meta charset="utf-8"></head><body><main{_CONTENT}' || m || '</main></body></html>' END AS h FROM d)
SELECT page_id, error, CASE WHEN error IS NULL THEN length(h) END AS n_chars, CASE WHEN error IS NULL THEN md5(h) END AS digest FROM f""")
def chapter_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.chapters(_shapes(spark, sf_dir), F.concat(F.lit("c"), _text("page_id")))
    return made.select("page_id", "error", F.char_length("html").cast("long").alias("n_chars"), _md5("html").alias("digest"))


def _blocks_sql(source: str) -> str:
    """The marked blocks of ``source`` (page_id, html) as CTEs up to ``k``."""
    return f"""m AS (SELECT page_id, {sql_marked('html', "'c' || page_id")} AS h FROM {source}),
b AS (SELECT page_id, string_split_regex(h, {sql_literal(P.BLOCK_ELEMENT)}) AS parts, regexp_extract_all(h, {sql_literal(P.BLOCK_ELEMENT)}) AS openings,
  regexp_extract_all(h, {sql_literal(P.BLOCK_ELEMENT)}, 1) AS tags, regexp_extract_all(h, {sql_literal(P.BLOCK_ELEMENT)}, 2) AS ids FROM m),
e AS (SELECT page_id, i, ids[i] AS block_id, {_LOWER.format('tags[i]')} AS tag, parts[i + 1] || array_to_string(list_transform(range(i + 1, len(tags) + 1), lambda j: openings[j] || parts[j + 1]), '') AS rest
  FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM b)),
k AS (SELECT page_id, block_id, tag, substr(rest, 1, greatest(instr({_LOWER.format('rest')}, '</' || tag) - 1, 0)) AS inner_html FROM e)"""


_PRE = "CASE WHEN page_id % 3 = 0 THEN replace(replace(html, '<article>', '<pre>'), '</article>', '</pre>') ELSE replace(replace(html, '<b>', '<code>'), '<br>', '</code><img src=\"a.png\">') END"


@query(f"""WITH s AS (SELECT page_id, {_PRE} AS html FROM pages), {_blocks_sql('s')},
g AS (SELECT page_id, block_id, tag, inner_html, string_split_regex(inner_html, {sql_literal(P.PROTECTED)}) AS q FROM k),
y AS (SELECT page_id, block_id, tag, inner_html, array_to_string(list_transform(q, lambda x, i: x || CASE WHEN i < len(q) THEN '{{{{GR' || (i - 1) || '}}}}' ELSE '' END), '') AS held FROM g),
z AS (SELECT page_id, block_id AS key, CASE WHEN tag = 'pre' THEN {sql_visible('inner_html')} ELSE {sql_visible('held')} END AS text FROM y
  UNION ALL SELECT page_id, 'metadata-chapter-title:c' || page_id, t FROM (SELECT page_id, nullif({sql_visible(f"regexp_extract(html, {sql_literal(P.TITLE)}, 1)")}, '') AS t FROM s) WHERE NOT regexp_matches(t, '[{_HAN2}]'))
SELECT page_id, key, length(text) AS n_chars, md5(text) AS digest FROM z""")
def translation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    pre = F.replace(F.replace(html, F.lit("<article>"), F.lit("<pre>")), F.lit("</article>"), F.lit("</pre>"))
    code = F.replace(F.replace(html, F.lit("<b>"), F.lit("<code>")), F.lit("<br>"), F.lit('</code><img src="a.png">'))
    ch = F.concat(F.lit("c"), _text("page_id"))
    pages = table(spark, sf_dir, "pages").select("page_id", ch.alias("chapter_id"), F.when(F.col("page_id") % 3 == 0, pre).otherwise(code).alias("html"))
    texts = C.translation_blocks(pages.select("page_id", "chapter_id", H.title(F.col("html")).alias("title"), H.mark_blocks(F.col("html"), F.col("chapter_id")).alias("html")))
    return texts.select("page_id", "key", F.char_length("text").cast("long").alias("n_chars"), _md5("text").alias("digest"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(rf"""WITH s AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html ELSE {sql_marked('html', "'c' || page_id")} END AS h, nullif({sql_visible(f"regexp_extract(html, {sql_literal(P.H1)}, 1)", active=False)}, '') AS o FROM pages),
r AS (SELECT page_id, CASE WHEN o IS NULL THEN NULL WHEN page_id % 2 = 1 THEN h ELSE regexp_replace(h, '(?is)(<h1\b[^>]*>\s*)' || regexp_escape({_ESC.format('o')}) || '(\s*</h1\s*>)', '\1New &lt;&amp;&gt; title\2') END AS title,
  regexp_replace(h, '(?is)(<a\b[^>]*\bhref\s*=\s*["'']/The["''][^>]*>\s*)The(\s*</a\s*>)', '\1T&amp;e\2') AS link FROM s)
SELECT page_id, md5(title) AS title, md5(link) AS link FROM r WHERE title IS NOT NULL""")
def replaced_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    marked = F.when(F.col("page_id") % 2 == 0, html).otherwise(H.mark_blocks(html, F.concat(F.lit("c"), _text("page_id"))))
    rows = table(spark, sf_dir, "pages").select("page_id", marked.alias("h"), H.heading(html).alias("o")).where("o IS NOT NULL")
    title = H.replace_element(F.col("h"), "h1", F.col("o"), F.lit("New <&> title"), unmarked=True)
    return rows.select("page_id", _md5(title).alias("title"), _md5(H.replace_anchor(F.col("h"), F.lit("/The"), F.lit("The"), F.lit("T&e"))).alias("link"))


_SOURCES = ['<img src="', '<img alt="x" src="/', '<img src="https://other.example/', '<img class=y src="pic.PNG?x=']
_PICTURES = f"(SELECT page_id, url, replace(html, '<a href=\"/', [{', '.join(map(sql_literal, _SOURCES))}][(page_id % 4 + 1)::INT]) AS html FROM pages)"


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.get(F.array(*[F.lit(x) for x in _SOURCES]), (F.col("page_id") % 4).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace(F.col("html"), F.lit('<a href="/'), new).alias("html"))


@query(rf"""WITH p AS (SELECT *, regexp_extract(url, '^[^/]+//[^/?#]*') AS origin, regexp_extract(url, '^[^/]+//[^/?#]*(/[^?#]*)?', 1) AS path, string_split_regex(html, {sql_literal(P.IMAGE_SOURCE)}) AS parts,
  regexp_extract_all(html, {sql_literal(P.IMAGE_SOURCE)}, 1) AS heads, regexp_extract_all(html, {sql_literal(P.IMAGE_SOURCE)}, 2) AS srcs, regexp_extract_all(html, {sql_literal(P.IMAGE_SOURCE)}, 3) AS tails FROM {_PICTURES}),
i AS (SELECT page_id, origin, path, unnest(range(1, len(srcs) + 1)) AS pos, unnest(srcs) AS src, unnest(heads) AS head, unnest(tails) AS tail FROM p),
t AS (SELECT *, CASE WHEN starts_with(src, '/') THEN origin || src WHEN regexp_matches(src, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN src ELSE origin || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || src END AS target FROM i),
o AS (SELECT *, regexp_extract(target, '^[^/]+//[^/?#]*') = origin AND starts_with(regexp_extract(target, '^[^/]+//[^/?#]*(/[^?#]*)?', 1), regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '')) AS ok FROM t),
n AS (SELECT *, sum(ok::INT) OVER (PARTITION BY page_id ORDER BY pos) AS n, lower(regexp_extract(regexp_replace(target, '[?#].*$', ''), '\.([^./]+)$', 1)) AS kind FROM o),
s AS (SELECT page_id, pos, ok AND n <= 500 AS local, CASE WHEN ok AND n <= 500 THEN head || '../assets/image-' || lpad(n::VARCHAR, 5, '0') || '.' || CASE WHEN kind IN ('jpg', 'jpeg', 'png', 'gif', 'webp', 'avif') THEN kind ELSE 'jpg' END || tail ELSE {sql_literal(P.MISSING_IMAGE)} END AS said FROM n),
g AS (SELECT page_id, list(said ORDER BY pos) AS said, count(*) FILTER (local) AS n_local FROM s GROUP BY page_id)
SELECT p.page_id, coalesce(n_local, 0) AS n_local, md5(parts[1] || coalesce(array_to_string(list_transform(range(1, len(said) + 1), lambda k: said[k] || parts[k + 1]), ''), '')) AS digest FROM p LEFT JOIN g USING (page_id)""")
def localized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.localized(_pictures(spark, sf_dir)).select("page_id", "n_local", _md5("html").alias("digest"))


_PRESENT = f"(SELECT page_id, src, length(src) % 2 = 0 OR starts_with(src, 'data:') AS present FROM (SELECT page_id, unnest(regexp_extract_all(html, {sql_literal(P.IMAGE_SOURCE)}, 2)) AS src FROM {_PICTURES}))"


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pictures(spark, sf_dir)
    listed = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(P.IMAGE_SOURCE), 2)).alias("path")).where("char_length(path) % 2 = 0")
    return C.image_issues(pages, listed)


@query(f"SELECT page_id, src AS source, present FROM {_PRESENT}")
def picture_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _presence(spark, sf_dir)


_QUALITY = f"""c AS (SELECT page_id, {_HOST} AS book, {sql_marked('html', "'c' || page_id")} AS h FROM pages),
i AS (SELECT page_id, count(*) FILTER (present) AS i, count(*) FILTER (NOT present) AS gone FROM {_PRESENT} GROUP BY page_id),
q AS (SELECT book, count(*) AS n_chapters, sum(len(regexp_extract_all(h, 'data-block-id\\s*=\\s*["''][^"'']+["'']')))::BIGINT AS n_blocks, coalesce(sum(i), 0)::BIGINT AS n_images, coalesce(sum(gone), 0)::BIGINT AS n_gone,
  sum(page_id % 5)::BIGINT AS n_originals FROM c LEFT JOIN i USING (page_id) GROUP BY book),
r AS (SELECT book, n_chapters, n_blocks, n_images, n_originals, CASE WHEN length(book) % 2 = 0 THEN n_blocks ELSE 0 END AS n_translated, n_gone + (n_blocks = 0)::INT AS n_errors,
  CASE WHEN n_originals > 0 AND n_originals < n_blocks THEN n_originals || '/' || n_blocks END AS warning FROM q)"""


def _quality(spark: SparkSession, sf_dir: str, images: str = "true") -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    book = book_of(F.col("url"))
    chapters = pages.select(book.alias("book"), "page_id", F.when(F.char_length(book) % 2 == 0, "zh-CN").alias("target"), H.mark_blocks(F.col("html"), F.concat(F.lit("c"), _text("page_id"))).alias("html"))
    return C.report(chapters, _presence(spark, sf_dir).where(images), pages.select("page_id", (F.col("page_id") % 5).alias("n")))


@query(f"WITH {_QUALITY} SELECT * FROM r")
def book_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir)


@query(f"WITH {_QUALITY.replace('FILTER (NOT present)', 'FILTER (NOT present AND page_id % 2 = 0)')} SELECT book, n_blocks FROM r WHERE n_errors = 0 AND length(book) % 3 <> 0")
def publishable_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    invalid = table(spark, sf_dir, "pages").select(book_of(F.col("url")).alias("book")).where("char_length(book) % 3 = 0")
    return C.publishable(_quality(spark, sf_dir, "present OR page_id % 2 = 0"), invalid).select("book", "n_blocks")


def _side_sql(name: str, source: str, first: str, items: bool) -> str:
    counts = f"NOT ({str(items).lower()} AND lower(tags[i]) <> 'li') AND (lower(tags[i]) <> 'blockquote' OR regexp_matches(attrs[i], {sql_literal(P.SIDE_QUOTE)}))"
    opens = f"(closes[i] = '' AND inside = '' AND {counts})"
    return f"""{name}_t AS (SELECT page_id, {first} AS base, x, string_split_regex(x, {sql_literal(P.SIDE_TAG)}) AS parts, regexp_extract_all(x, {sql_literal(P.SIDE_TAG)}) AS alls, regexp_extract_all(x, {sql_literal(P.SIDE_TAG)}, 1) AS closes,
  regexp_extract_all(x, {sql_literal(P.SIDE_TAG)}, 2) AS tags, regexp_extract_all(x, {sql_literal(P.SIDE_TAG)}, 3) AS attrs FROM {source}),
{name}_r AS (SELECT page_id, 1 AS i, '' AS inside, 0 AS n, parts[1] AS out FROM {name}_t UNION ALL
  SELECT page_id, i + 1, CASE WHEN {opens} THEN lower(tags[i]) WHEN closes[i] = '/' AND inside = lower(tags[i]) THEN '' ELSE inside END, n + {opens}::INT,
  out || CASE WHEN {opens} THEN '<' || tags[i] || attrs[i] || ' data-block-id="c' || page_id || '-b' || printf('%04d', base + n + 1) || '">' ELSE alls[i] END || parts[i + 1] FROM {name}_r JOIN {name}_t USING (page_id) WHERE i <= len(tags)),
{name} AS (SELECT page_id, arg_max(n, i) AS n, arg_max(out, i) AS out FROM {name}_r GROUP BY page_id)"""


_QUOTED = "replace(replace(html, '<nav>', CASE page_id % 3 WHEN 0 THEN '<blockquote class=\"epigraph\">' WHEN 1 THEN '<blockquote>' ELSE '<nav>' END), '</nav>', '</blockquote>')"


@query(f"""WITH RECURSIVE q AS (SELECT page_id, {_QUOTED} AS h FROM pages), a AS (SELECT page_id, substr(h, instr(h, '<article>')) AS x FROM q), {_side_sql('body', 'a', '0', False)},
z AS (SELECT page_id, substr(h, 1, instr(h, '<article>') - 1) AS x, n FROM q JOIN body USING (page_id)), {_side_sql('pre', 'z', 'n', True)}, {_side_sql('every', '(SELECT page_id, h AS x FROM q)', '0', False)}
SELECT page_id, body.n AS n_body, pre.n AS n_pre, every.n AS n_every, md5(body.out) AS body, md5(pre.out) AS pre, md5(every.out) AS every FROM body JOIN pre USING (page_id) JOIN every USING (page_id)""")
def side_chapter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("page_id") % 3 == 0, '<blockquote class="epigraph">').when(F.col("page_id") % 3 == 1, "<blockquote>").otherwise("<nav>")
    html = F.replace(F.replace(F.col("html"), F.lit("<nav>"), new), F.lit("</nav>"), F.lit("</blockquote>"))
    rows = table(spark, sf_dir, "pages").select("page_id", html.alias("h"), F.concat(F.lit("c"), _text("page_id")).alias("ch"))
    at = F.instr("h", F.lit("<article>"))
    made = rows.select("page_id", "ch", F.left("h", at - 1).alias("before"), C.side_blocks(F.substr("h", F.greatest(at, F.lit(1))), F.col("ch"), F.lit(0)).alias("b"), C.side_blocks(F.col("h"), F.col("ch"), F.lit(0)).alias("e"))
    made = made.withColumn("p", C.side_blocks(F.col("before"), F.col("ch"), F.col("b.n"), list_items=True))
    return made.select("page_id", F.col("b.n").alias("n_body"), F.col("p.n").alias("n_pre"), F.col("e.n").alias("n_every"), _md5("b.html").alias("body"), _md5("p.html").alias("pre"), _md5("e.html").alias("every"))


@query("""SELECT 'text/ch' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.htm' ELSE '.html' END AS path, 'text/ch' || p_partkey || '.en.js' AS side FROM part WHERE p_size % 2 = 0 AND p_partkey % 4 < 2""")
def side_source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    stem = F.concat(F.lit("text/ch"), _text("p_partkey"))
    html = part.select(F.concat(stem, F.when(F.col("p_partkey") % 3 == 0, ".htm").otherwise(".html")).alias("path"), F.lit("<p>").alias("content"))
    side = part.where("p_size % 2 = 0").select(F.concat(stem, F.lit(".en.js")).alias("path"), F.when(F.col("p_partkey") % 4 < 2, "window.EN_TEXT = ['a']").otherwise("var x").alias("content"))
    return C.side_sources(html.unionByName(side)).select("path", "side")


@query("""WITH g AS (SELECT conv_id, list(turn ORDER BY turn) AS t, list(md5(text) ORDER BY turn) AS x FROM conversations GROUP BY conv_id), o AS (SELECT conv_id, t, CASE WHEN conv_id % 3 = 0 THEN x[:len(x) - 1] ELSE x END AS x FROM g)
SELECT conv_id AS chapter_id, 'b' || unnest(t) AS block_id, unnest(x) AS original, NULL::VARCHAR AS error FROM o WHERE len(t) = len(x)
UNION ALL SELECT conv_id, NULL, NULL, len(t) || ' blocks, ' || len(x) || ' originals' FROM o WHERE len(t) <> len(x)""")
def paired_original_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter_id"), F.col("turn").alias("ord"), F.concat(F.lit("b"), _text("turn")).alias("block_id"), _md5("text").alias("text"))
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    originals = rows.groupBy("chapter_id").agg(all_.alias("texts")).withColumn("texts", F.when(F.col("chapter_id") % 3 == 0, F.slice("texts", 1, F.size("texts") - 1)).otherwise(F.col("texts")))
    return C.paired_originals(rows, originals)


@query("""WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'assistant')
SELECT u.conv_id AS book, u.place::INT AS place, u.turn AS asked, a.turn AS told FROM u JOIN a ON a.conv_id = u.conv_id AND a.place = u.place""")
def zipped_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("ord"), "role")
    return C.paired_by_place(rows.where("role = 'user'").withColumn("asked", F.col("ord")), rows.where("role = 'assistant'").withColumn("told", F.col("ord")), "book", "asked", "told")


@query("SELECT p_brand AS book, p_partkey, CASE WHEN p_size % 2 = 0 THEN 'chapter-' || p_partkey ELSE '' END AS chapter_id FROM part")
def chapter_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("ch"), _text("p_partkey"), F.lit(".html"))
    shape = F.when(F.col("p_partkey") % 3 == 0, "text/./").when(F.col("p_partkey") % 3 == 1, "text//").otherwise("text/img/../")
    asked = part.select(F.col("p_brand").alias("book"), "p_partkey", F.concat(shape, name).alias("path"))
    known = part.where("p_size % 2 = 0").select(F.col("p_brand").alias("book"), F.concat(F.lit("text/"), name).alias("path"), F.concat(F.lit("chapter-"), _text("p_partkey")).alias("chapter_id"))
    return C.chapter_at(asked, known).drop("path")


@query("SELECT conv_id AS book, role AS chapter, turn AS block_id, md5(text) AS digest FROM conversations WHERE role = 'assistant'")
def side_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("role").alias("chapter"), F.col("turn").alias("block_id"), _md5("text").alias("digest"))
    return C.side_text(rows.select("book", F.lit("assistant").alias("chapter")).distinct(), rows)


@query(rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), p AS (SELECT doc_id, unnest(range(1, len(x) + 1))::INT AS page, unnest(x) AS t FROM l),
s AS (SELECT doc_id, page, (doc_id + page) % 2 = 0 AND length(regexp_replace(t, '[^\p{{L}}\p{{Nl}}\p{{N}}]', '', 'g')) < 20 AS sparse FROM p),
g AS (SELECT doc_id, count(*) AS n, coalesce(list(page ORDER BY page) FILTER (sparse), []) AS found, list(page ORDER BY page) AS pages FROM s GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(found) = 0 THEN 'digital' WHEN len(found) = n THEN 'scanned' ELSE 'mixed' END AS kind,
array_to_string(CASE doc_id % 3 WHEN 0 THEN found WHEN 1 THEN [] ELSE pages END, ',') AS to_read, array_to_string(CASE doc_id % 3 WHEN 1 THEN found ELSE [] END, ',') AS uncertain FROM g""")
def paged_text_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "\n", "\f").alias("text")).where("text IS NOT NULL")
    pages = D.split_pages(docs, F.size(F.split("text", "\f", -1))).select(F.col("doc_id").alias("doc"), F.col("page").cast("int").alias("page"), "text")
    mode = F.get(F.array(F.lit("auto"), F.lit("text"), F.lit("read")), (F.col("doc") % 3).cast("int"))
    kinds = C.paged_kind(pages, pages.where("(doc + page) % 2 = 0"), mode)
    return kinds.select(F.col("doc").alias("doc_id"), "kind", F.array_join("to_read", ",").alias("to_read"), F.array_join("uncertain", ",").alias("uncertain"))


_EDITS = """ed AS (SELECT event_id // 3 * 2 AS id, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE ' e' || event_id || ' ' END AS note, event_id AS "at" FROM events), an AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'bookmark' ELSE 'highlight' END AS kind FROM events)"""


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = F.col("event_id")
    events = table(spark, sf_dir, "events")
    kind = F.when(e % 3 == 0, "note").when(e % 3 == 1, "bookmark").otherwise("highlight")
    edits = events.select((F.floor(e / 3) * 2).alias("id"), F.when(e % 7 == 0, "  ").otherwise(F.concat(F.lit(" e"), _text("event_id"), F.lit(" "))).alias("note"), e.alias("at"))
    return events.select(e.alias("id"), kind.alias("kind"), F.lit("old").alias("note"), F.lit(0).cast("long").alias("updated_at")), edits


@query(f"""WITH {_EDITS}, b AS (SELECT id, arg_max(trim(note), "at") AS t, max("at") AS "at" FROM ed WHERE trim(note) <> '' GROUP BY id)
SELECT an.id, kind, CASE WHEN kind = 'note' AND t IS NOT NULL THEN t ELSE 'old' END AS note, CASE WHEN kind = 'note' AND t IS NOT NULL THEN "at" ELSE 0 END AS updated_at FROM an LEFT JOIN b USING (id)""")
def edited_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.edited_notes(*_edits(spark, sf_dir))


@query(f"""WITH {_EDITS} SELECT ed.id, "at", CASE WHEN trim(note) = '' THEN 'blank' ELSE 'no-note' END AS error FROM ed LEFT JOIN (SELECT id FROM an WHERE kind = 'note') n ON n.id = ed.id WHERE trim(note) = '' OR n.id IS NULL""")
def note_edit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.edit_errors(*_edits(spark, sf_dir))


@query("""WITH b AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') SELECT 'tasks' AS name, count(*) AS n FROM orders WHERE o_custkey NOT IN (FROM b)
UNION ALL SELECT 'messages', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (FROM b)""")
def cleared_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), "o_orderkey")
    messages = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    books = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("book_id"))
    left = K.cleared({"tasks": orders, "messages": messages}, books)
    return left["tasks"].agg(F.lit("tasks").alias("name"), F.count("*").alias("n")).unionByName(left["messages"].agg(F.lit("messages").alias("name"), F.count("*").alias("n")))


@query("""WITH a AS (SELECT event_id AS id, user_id AS book, regexp_extract(props, ':\\s*([0-9]+)', 1)::INT AS s, CASE WHEN event_type = 'click' THEN 'note' ELSE 'highlight' END AS kind FROM events)
SELECT id, book, kind, row_number() OVER (PARTITION BY book ORDER BY id DESC)::INT AS newest, (CASE WHEN kind = 'highlight' THEN row_number() OVER (PARTITION BY book, kind ORDER BY s, s + id % 3, id) END)::INT AS in_text FROM a""")
def annotation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e.alias("id"), F.col("user_id").alias("book"), F.get_json_object("props", "$.k").cast("int").alias("s"), F.when(F.col("event_type") == "click", "note").otherwise("highlight").alias("kind"))
    newest = K.newest_first(K.listed(rows), "book", "id", "id").select("id", "book", "kind", F.col("place").alias("newest"))
    marks = K.by_offset(K.listed(rows, "highlight").withColumn("e", F.col("s") + F.col("id") % 3), "book", "s", "e", "id")
    return newest.join(marks.select("id", F.col("place").alias("in_text")), "id", "left")


@query("SELECT o_orderkey, 'session' AS what FROM orders WHERE o_custkey = 5 AND o_orderpriority = '1-URGENT' UNION ALL SELECT r_regionkey, 'setting' FROM region WHERE r_name = 'ASIA'")
def keyed_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = K.at_key(table(spark, sf_dir, "orders"), o_custkey=5, o_orderpriority="1-URGENT").select("o_orderkey", F.lit("session").alias("what"))
    return session.union(K.at_key(table(spark, sf_dir, "region"), r_name="ASIA").select(F.col("r_regionkey").cast("long"), F.lit("setting")))


_TASKS = """tk AS (SELECT o_orderkey AS id, o_custkey AS book, o_orderdate AS "at", CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'cancelled' END END AS status FROM orders)"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(s == "O", "queued").when(s == "P", "running").when(F.col("o_orderkey") % 2 == 0, "completed").otherwise("cancelled")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("book"), F.col("o_orderdate").alias("at"), status.alias("status"))


@query(f"""WITH {_TASKS} SELECT id, row_number() OVER (PARTITION BY book ORDER BY "at" DESC, id DESC)::INT AS place FROM tk WHERE status NOT IN ('completed', 'cancelled')""")
def unfinished_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.newest_first(_tasks(spark, sf_dir).where(K.unfinished(F.col("status"))), "book", "at", "id").select("id", "place")


@query(f"""WITH {_TASKS} SELECT book, arg_min(id, ("at", id)) AS id FROM tk WHERE status = 'queued' GROUP BY book""")
def next_queued_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.next_queued(_tasks(spark, sf_dir), "book", "id", "at")


@query(f"""WITH {_TASKS}, q AS (SELECT * FROM tk WHERE status = 'queued'), w AS (SELECT id, book, id AS o, row_number() OVER (PARTITION BY book ORDER BY id) AS n, count(*) OVER (PARTITION BY book) AS c FROM q)
SELECT id, book, CASE WHEN book % 3 = 0 AND c > 1 AND n = 1 THEN lead(o) OVER x WHEN book % 3 = 0 AND c > 1 AND n = 2 THEN lag(o) OVER x WHEN book % 3 = 1 AND c > 1 AND n = c THEN lag(o) OVER x WHEN book % 3 = 1 AND c > 1 AND n = c - 1 THEN lead(o) OVER x ELSE o END AS o
FROM w WINDOW x AS (PARTITION BY book ORDER BY n)""")
def queue_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _tasks(spark, sf_dir).where("status = 'queued'").select("id", "book", F.col("id").alias("o"))
    ends = queue.groupBy("book").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    moves = ends.where("book % 3 < 2").select(F.when(F.col("book") % 3 == 0, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(F.col("book") % 3 == 0, 1).otherwise(-1).alias("step"))
    return K.swapped(queue, moves, "book", "id", "o")


@query("SELECT event_id AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'ch' || event_id % 50 END AS title FROM events LEFT JOIN part ON p_partkey = event_id % 50")
def annotation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("ch"), c.cast("string"))
    notes = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), name(F.col("event_id") % 50).alias("chapter_id"))
    chapters = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(name(F.col("p_partkey")).alias("chapter_id"), F.col("p_name").alias("title"))
    return K.titled(notes, chapters).select("id", "title")


@query("SELECT o_custkey AS book_id, o_orderkey AS task_id, 'assistant' AS role, 'said ' || l_linenumber AS content, epoch_ms(l_shipdate) AS created_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'")
def answer_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("task_id"))
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("task_id"), F.concat(F.lit("said "), _text("l_linenumber")).alias("content"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("at"))
    return K.answers(tasks, done)


@query("""WITH l AS (SELECT l_orderkey AS k, max(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS task_id, CASE WHEN n IS NULL THEN o_orderstatus ELSE 'p' || n END AS phase, CASE WHEN n IS NULL THEN 'kept' WHEN n % 2 = 0 THEN NULL ELSE 'o' || n END AS partial, coalesce(n, 0)::INT AS sequence FROM orders LEFT JOIN l ON k = o_orderkey""")
def live_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("phase"), F.lit("kept").alias("partial"), F.lit(0).alias("sequence"))
    live = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.max("l_linenumber").alias("sequence"))
    n = F.col("sequence").cast("string")
    return K.with_live(tasks, live.withColumn("phase", F.concat(F.lit("p"), n)).withColumn("partial", F.when(F.col("sequence") % 2 == 0, "").otherwise(F.concat(F.lit("o"), n))))


@query("""WITH c AS (SELECT o_custkey AS id, string_agg('/books/' || o_custkey || '/' || o_orderkey || '.html' || CASE WHEN o_orderstatus = 'F' THEN '+' ELSE '' END, ' ' ORDER BY o_orderkey) AS chapters FROM orders GROUP BY 1)
SELECT c_custkey AS id, c_name AS title, '/api/books/' || c_custkey || '/cover?v=' || CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey ELSE 0 END AS cover_url, '/books/' || c_custkey || '/index.html' AS entry_url, chapters FROM customer LEFT JOIN c ON id = c_custkey""")
def book_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("index.html").alias("entry"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("version"))
    chapters = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.concat(_text("o_orderkey"), F.lit(".html")).alias("path"), F.when(F.col("o_orderstatus") == "F", "p").alias("parallel"))
    said = F.array_join(F.transform("chapters", lambda c: F.concat(c["url"], F.when(c["has_parallel"], "+").otherwise(""))), " ")
    return K.summaries(books, chapters).select("id", "title", "cover_url", "entry_url", said.alias("chapters"))


@query("""SELECT event_id, event_id % 5 <> 0 AND (event_type = 'click' OR event_id % 7 = 0) AS found, event_id % 5 <> 0 AND event_id % 3 = 0 AS quoted FROM events""")
def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    deep = F.concat(F.lit('[1, {"a": [null, {"'), F.col("event_type"), F.lit('": "'), F.when(e % 7 == 0, "click").otherwise("clicks"), F.lit('", "q": "'), F.when(e % 3 == 0, 'say \\"hi\\"').otherwise("hi"), F.lit('"}]}'), F.when(e % 5 == 0, "").otherwise("]"))
    rows = table(spark, sf_dir, "events").select("event_id", deep.alias("j"))
    return rows.select("event_id", K.holds_string(F.col("j"), "click").alias("found"), K.holds_string(F.col("j"), 'say "hi"').alias("quoted"))


@query("""SELECT c_custkey AS book_id, CASE WHEN c_custkey % 6 IN (1, 2, 4) THEN 'r' || c_custkey % 6 WHEN c_nationkey % 5 IN (1, 2, 4) THEN 'r' || c_nationkey % 5 ELSE 'r2' END AS runtime FROM customer""")
def runtime_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), F.concat(F.lit("r"), (F.col("c_custkey") % 6).cast("string")).alias("current"), F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string")).alias("active"))
    return K.chosen_runtime(books, spark.createDataFrame([("r2", 0), ("r1", 1), ("r4", 2)], "runtime string, ord int"))


@query("SELECT coalesce(sum(length(doc_id::VARCHAR) + length(text)), 0)::BIGINT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def chars_for_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chars_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query("SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN value END AS metric, CASE WHEN event_id % 11 = 0 THEN 'r' || event_id END AS runtime FROM events WHERE event_type = 'purchase' OR event_id % 11 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_measured_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("metric"), F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("r"), _text("event_id"))).alias("runtime"))
    return K.last_measured(events, "user_id", "event_id", ["metric", "runtime"])


@query("""WITH b AS (SELECT user_id, unnest(range(user_id % 10, 500, 37)) AS p FROM (SELECT DISTINCT user_id FROM events)) SELECT event_id, arg_min('b' || p, (abs(value - p), p)) AS block_id FROM events JOIN b USING (user_id) GROUP BY event_id""")
def nearest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    blocks = events.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.col("user_id") % 10, F.lit(499), F.lit(37))).alias("p"))
    return K.nearest(events, blocks.withColumn("block_id", F.concat(F.lit("b"), _text("p"))), "user_id", "value", "p", "block_id").select("event_id", "block_id")


@query("SELECT event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS place FROM events")
def merged_event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e.alias("id"), "user_id", F.when(e % 4 == 0, 0).otherwise(e).alias("seq"), (e * 10 + 5).alias("created_at"))
    return K.merged_place(rows, "user_id").select("id", "place")


@query(f"SELECT page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY url, page_id % 3, page_id)::INT AS place FROM pages WHERE url IS NOT NULL")
def issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", book_of(F.col("url")).alias("book"), F.col("url").alias("path"), (F.col("page_id") % 3).alias("problem"))
    return K.issues_by_path(rows, "book", ident="page_id").select("page_id", "place")


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, epoch(date_trunc('second', ts))::BIGINT AS started, CASE WHEN event_type <> 'error' THEN epoch(date_trunc('second', ts))::BIGINT END AS other FROM events")
def clock_and_process_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", ts.alias("ts"), F.date_format(ts, "EEE MMM d HH:mm:ss yyyy").alias("said"))
    padded = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("  "), F.regexp_replace("said", r" ([0-9]) ", "  $1 "))).otherwise(F.col("said"))
    dayless = F.when(F.col("event_type") == "error", F.regexp_replace("said", "^[A-Za-z]+ ", "")).otherwise(F.col("said"))
    return rows.select("event_id", K.event_clock(F.unix_millis("ts")).alias("clock"), F.unix_seconds(K.process_start(padded)).alias("started"), F.unix_seconds(K.process_start(dayless)).alias("other"))


@query("""WITH n AS (SELECT p_partkey, p_size, p_partkey * p_size * 2 + 1 AS n, CASE WHEN p_size % 10 = 0 THEN '-_-' ELSE replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN '_' ELSE '--' END) || '.' || p_type END AS stem FROM part)
SELECT p_partkey, CASE WHEN n >= 10000 THEN printf('%.1f', n / 10000) || '万' ELSE format('{:,}', n) END AS shown,
CASE WHEN trim(translate(stem, '-_', '  ')) = '' THEN '第 ' || p_partkey || ' 章' ELSE trim(regexp_replace(translate(stem, '-_', '  '), ' +', ' ', 'g')) END AS title FROM n""")
def counts_and_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.when(size % 2 == 0, "_").otherwise("--")), F.lit("."), "p_type")
    path = F.concat(F.lit("text/"), F.when(size % 10 == 0, "-_-").otherwise(name), F.lit(".html"))
    return table(spark, sf_dir, "part").select("p_partkey", K.compact_count(k * size * 2 + 1).alias("shown"), X.file_stem_title(path, k).alias("title"))


@query("""WITH s AS (SELECT user_id, event_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'translation.batch.' || event_id WHEN 'click' THEN 'pdf.page.' || event_id WHEN 'error' THEN NULL ELSE event_type END AS scope FROM events),
u AS (SELECT user_id, arg_max(scope, seq) FILTER (starts_with(scope, 'translation.batch.') OR starts_with(scope, 'pdf.page.')) AS scope FROM s GROUP BY user_id)
SELECT user_id AS task_id, event_id::VARCHAR AS id, seq, 'd' AS detail, scope FROM s UNION ALL SELECT user_id, 'live-output', 0, CASE user_id % 4 WHEN 0 THEN 'out' WHEN 1 THEN 'err' ELSE 'started' END, scope FROM u WHERE user_id % 4 < 3""")
def live_event_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, e, u = F.col("event_type"), _text("event_id"), F.col("user_id")
    scope = F.when(kind == "view", F.concat(F.lit("translation.batch."), e)).when(kind == "click", F.concat(F.lit("pdf.page."), e)).when(kind != "error", kind)
    events = table(spark, sf_dir, "events")
    log = events.select(u.alias("task_id"), e.alias("id"), F.col("event_id").alias("seq"), F.lit("d").alias("detail"), scope.alias("scope"), F.lit(1).cast("long").alias("created_at"))
    workers = events.select("user_id").distinct().select(u.alias("task_id"), F.when(u % 4 == 0, " out\n").otherwise(" ").alias("stdout"), F.when(u % 4 < 2, "err").otherwise("").alias("stderr"), F.when(u % 4 == 2, 7).alias("pid"), F.lit(9).cast("long").alias("at"))
    return K.with_live_event(log, workers.withColumn("stdout", F.regexp_replace("stdout", r"^\s+|\s+$", ""))).drop("created_at")


@query("SELECT o_orderkey AS task_id, greatest(o_orderkey % 100, 42) AS progress FROM orders WHERE o_orderkey % 100 >= 42 AND o_orderstatus <> 'F'")
def resumed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    candidates = orders.select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "bad").alias("error"))
    return K.resumed(orders.select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 100).alias("progress")), candidates)


@query("""WITH o AS (SELECT user_id, row_number() OVER w AS n, ['transient', 'invalid', 'transient', 'ok', 'invalid', 'permanent'][(event_id * 7 % 6 + 1)::INT] AS o, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum((o = 'invalid')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM o), e AS (SELECT user_id, min(n) FILTER (o IN ('ok', 'permanent') OR bad >= 3 OR n >= 6) AS stop, max(n) AS seen FROM b GROUP BY user_id)
SELECT e.user_id, coalesce(stop, seen)::INT AS used, CASE WHEN stop IS NULL THEN 'open' WHEN o = 'ok' THEN 'ok' ELSE 'failed' END AS result FROM e LEFT JOIN b ON b.user_id = e.user_id AND n = stop""")
def attempt_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("transient", "invalid", "transient", "ok", "invalid", "permanent")])
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.get(names, (F.col("event_id") * 7 % 6).cast("int")).alias("outcome"))
    return K.attempts(log, "user_id", "event_id", "outcome")


@query("SELECT d <> '2024-01-03' AS due, d AS value FROM (VALUES ('2024-01-03'), ('2024-01-04')) t(d)")
def daily_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    settings = table(spark, sf_dir, "region").select(F.when(k == 3, "last_auto_backup_date").otherwise(F.col("r_name")).alias("key"), F.concat(F.lit("2024-01-0"), k.cast("string")).alias("value"))
    return K.backup_due(settings, F.lit("2024-01-03")).unionByName(K.backup_due(settings, F.lit("2024-01-04")))


@query("SELECT conv_id AS book_id, md5(string_agg(to_json({'role': role, 'content': text})::VARCHAR, chr(10) ORDER BY turn)) AS digest, count(*) AS n FROM conversations GROUP BY conv_id")
def message_history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), "turn", "role", F.col("text").alias("content"))
    lines = K.history(rows, "book_id", "turn")
    return lines.select("book_id", _md5("lines").alias("digest"), F.size(F.split("lines", "\n")).cast("long").alias("n"))


@query(r"""WITH p AS (SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN '/other/' WHEN p_size % 7 = 0 THEN '/shelf/../' ELSE '/shelf/' END || CASE WHEN p_size % 5 = 0 THEN '..' ELSE replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN '/' ELSE '_' END) END
  || CASE WHEN contains(p_brand, '1') THEN '/' ELSE '' END AS path FROM part), c AS (SELECT p_partkey, regexp_replace(path, '/+$', '') AS path FROM p)
SELECT p_partkey, regexp_extract(path, '^(.*)/[^/]+$', 1) = '/shelf' AND regexp_extract(path, '([^/]*)$', 1) NOT IN ('', '.', '..') AS ok FROM c""")
def deletable_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    name = F.when(size % 5 == 0, "..").otherwise(F.replace(F.col("p_name"), F.lit(" "), F.when(size % 2 == 0, "/").otherwise("_")))
    path = F.concat(F.when(F.col("p_type") == "SMALL", "/other/").when(size % 7 == 0, "/shelf/../").otherwise("/shelf/"), name, F.when(F.contains("p_brand", F.lit("1")), "/").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", K.deletable(F.lit("/shelf/"), path).alias("ok"))


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'T' || doc_id ELSE md5(text) END AS text FROM documents")
def mapped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "documents").select("doc_id", _md5("text").alias("text"))
    given = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("T"), _text("doc_id"))).otherwise("  ").alias("text"))
    return K.map_blocks(blocks, given, "doc_id")
