"""The property graph as tables: specifications, entities, mentions, co-occurrence, hierarchy, lookups.

Nodes and edges are aggregations by key, so loading twice gives the same tables. Pairs are formed within one sentence only, whose entities are few; term lookups
compare a question's terms with distinct names, not with rows. Null texts have no entities or specs; names are compared as they are unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as X
from docloom.session import broadcast_checked, cut

# Units in the order of their alternatives, subjects that name nothing, connectives are in the pattern.
SPEC_UNITS = (
    "rpm|kn|kpa|mpa|bar|kg|kgs|g|mg|°c|°f|k|ghz|mhz|khz|hz|kbps|mbps|gbps|bps|ms|ns|us|s|sec|min|h|hr|mm|cm|m|km|nm|um|in|ft|v|kv|mv|w|kw|mw|a|ma|ka|n|nm|j|kj|mj|pa|hpa|atm|psi|torr|l|ml|cc|m3|t|ton|lb|lbf|deg|rad|percent|%"
)
IGNORED_SUBJECTS = "a an the this that it he she they which where when about after with from total each per average maximum minimum typical approximately around nearly roughly"
SPEC_PATTERN = rf"([A-Za-z0-9_][A-Za-z0-9_\s/\-]{{1,35}}?)\s*(?:of|at|is|was|:|=)?\s*([0-9][,0-9]*(?:\.[0-9]+)?)\s*({SPEC_UNITS})\b"
ENTITY_PATTERN = r"^[A-Z][a-z]{5,}$"
#: What the stand-in for a recognition model takes for a quantity, a code, a name: the first group.
QUANTITY_PATTERN = rf"([0-9][,0-9]*(?:\.[0-9]+)?\s*(?:{SPEC_UNITS})\b)"
CODE_PATTERN, NAME_PATTERN = r"(?:^|[^A-Za-z0-9_])([A-Z]{2,}-?[0-9]+)", r"(?:^|[^A-Za-z0-9_])([A-Z][a-z]{5,})"
# Fixed value: the least characters of a sentence in which entities are looked for.
LEAST_SENTENCE = 20
# Fixed value: how many sections and specifications the model takes from the graph.
GRAPH_LIMIT = 50


def entity_name(text) -> Column:
    """A name in lower case without outer and double white space."""
    return F.lower(X.strip(F.regexp_replace(X.text_of(text), r"[\s\p{Z}]+", " ")))


def spec_mentions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, subject, value_text, value, unit): the quantities in running text whose subject names something; of a text's quantities with the same
    subject, value and unit the first. A text is searched once for whole matches; the parts are taken from these, anchored at both ends."""
    found = F.regexp_extract_all(F.col(text), F.lit("(?i)" + SPEC_PATTERN), F.lit(0))
    rows = texts.where(F.col(text).rlike("[0-9]")).select(key, F.posexplode(found).alias("pos", "_m"))
    part = lambda g: F.regexp_extract("_m", "(?i)^" + SPEC_PATTERN.removesuffix(r"\b") + "$", g)
    subject = F.regexp_replace(F.regexp_replace(X.strip(part(1)), r"\s+", " "), r"^[ \-:/,.]+|[ \-:/,.]+$", "")
    rows = rows.select(key, "pos", F.lower(subject).alias("subject"), part(2).alias("value_text"), F.regexp_replace(part(2), ",", "").try_cast("double").alias("value"), F.lower(part(3)).alias("unit"))
    ignored = F.col("subject").isin(IGNORED_SUBJECTS.split())
    rows = rows.where(~ignored & (F.length("subject") >= 3) & ~F.col("subject").rlike("^[0-9]") & F.col("value").isNotNull())
    first = rows.groupBy(key, "subject", "value_text", "unit").agg(F.min("pos").alias("pos"), F.first("value").alias("value"))
    return first.select(key, "pos", "subject", "value_text", "value", "unit")


def spec_nodes(spec: DataFrame) -> DataFrame:
    """(book_id, subject, unit, value, raw, section) by book, subject and unit: the last value and text, the first section."""
    rows = spec.select("spec_id", "book_id", "subject", F.lower(F.coalesce("unit", F.lit(""))).alias("unit"), "value", "raw", "section").distinct()
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("spec_id")))
    return rows.groupBy("book_id", "subject", "unit").agg(last("value").alias("value"), last("raw").alias("raw"), F.min_by("section", F.when(F.col("section").isNotNull(), F.col("spec_id"))).alias("section"), F.count("*").alias("n_seen"))


def contained(inner: DataFrame, outer: DataFrame, a: str, b: str, head: int = 4) -> DataFrame:
    """(a, b): the distinct texts of `outer` that hold one of `inner`. They are joined on the first characters of what is held, which is a part
    of what holds it; empty texts are held by none."""
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.substring(F.col(b), i, F.lit(n)))
    keyed = outer.select(b).where(F.length(b) > 0).distinct().select(b, F.explode(F.array_distinct(F.concat(*(parts(n) for n in range(1, head + 1))))).alias("_key"))
    heads = inner.select(a).where(F.length(a) > 0).distinct().select(a, F.substring(a, 1, head).alias("_key"))
    return heads.join(keyed, "_key").where(F.contains(F.col(b), F.col(a))).select(a, b)


def in_books(book: Column) -> Column:
    """Whether a book is within a question's filter; none, an empty filter and a question over all books mean all."""
    return F.col("cross_book") | F.coalesce(F.size("book_ids") <= 0, F.lit(True)) | F.coalesce(F.array_contains("book_ids", book), F.lit(False))


def _first_of(rows: DataFrame, per: list[str], order: list[str], limit: int | None) -> DataFrame:
    """The first `limit` distinct values of the columns `order` of each group; all without a limit."""
    rows = rows.select(*dict.fromkeys([*per, *order]))
    if limit is not None:
        rows = rows.withColumn("_n", F.dense_rank().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")
    return rows.distinct()


def _first_matches(terms: DataFrame, matched: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """(query_id, order): of each question the first `limit` distinct values among what its terms match (term, book_id, order) within its books. The first of a question are among the first
    of its terms, over all books or in one book: questions are joined to those only, so that their pairs with all that a frequent term matches aren't formed."""
    everywhere = F.coalesce(F.col("cross_book") | F.coalesce(F.size("book_ids") <= 0, F.lit(True)), F.lit(False))
    anywhere = terms.where(everywhere).select("query_id", "term").distinct()
    within = terms.where(~everywhere).select("query_id", "term", F.explode("book_ids").alias("book_id")).where(F.col("book_id").isNotNull()).distinct()
    asked = broadcast_checked(cut(within.select("term", "book_id").distinct()))
    by_term = _first_of(matched.join(anywhere.select("term").distinct(), "term", "left_semi"), ["term"], order, limit)
    by_book = _first_of(matched.join(asked, ["term", "book_id"], "left_semi"), ["term", "book_id"], order, limit)
    rows = anywhere.join(by_term, "term").select("query_id", *order).unionByName(within.join(by_book, ["term", "book_id"]).select("query_id", *order))
    return _first_of(rows, ["query_id"], order, limit)


def spec_lookup(terms: DataFrame, spec: DataFrame, limit: int | None = GRAPH_LIMIT) -> DataFrame:
    """(query_id, book_id, subject, unit, value, raw, section): specification nodes with a raw text whose subject holds a term of the question or lies in
    one, within its books. `terms` is (query_id, term, book_ids, cross_book). `limit` is the model's; null gives all."""
    nodes = cut(spec_nodes(spec.where(F.col("subject").isNotNull())).where(F.col("raw").isNotNull() & F.col("book_id").isNotNull()).withColumn("_name", F.lower("subject")))
    either = contained(terms, nodes, "term", "_name").unionByName(contained(nodes, terms, "_name", "term")).distinct()
    matched = cut(either).join(nodes.select("book_id", "subject", "unit", "_name"), "_name")
    hits = _first_matches(terms, matched, ["book_id", "subject", "unit"], limit)
    return hits.join(nodes, ["book_id", "subject", "unit"]).select("query_id", "book_id", "subject", "unit", "value", "raw", "section")


def sections_of_terms(terms: DataFrame, entity_section: DataFrame, limit: int | None = GRAPH_LIMIT) -> DataFrame:
    """(query_id, section): the sections and subsections that mention an entity whose name is a term of the question, or, for terms of four characters at
    least, holds one or lies in one; within the question's books. `limit` is the model's; null gives all."""
    nodes = entity_section.select("book_id", "section", F.lower("name").alias("_name")).distinct()
    long = terms.where(F.length("term") >= 4)
    same = terms.select("term").distinct().join(nodes.select("_name").distinct(), F.col("term") == F.col("_name"))
    either = same.unionByName(contained(long, nodes, "term", "_name")).unionByName(contained(nodes, long, "_name", "term").select("term", "_name")).distinct()
    return _first_matches(terms, cut(either).join(nodes, "_name"), ["section"], limit)


def recognised(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, name, label, raw): what the stand-in for a recognition model finds: quantities, codes of letters and digits, capitalised words of six letters
    and more. Names are normalised; of a text's finds with one name and label the first is kept."""
    labelled = [("Quantity", QUANTITY_PATTERN), ("Code", CODE_PATTERN), ("Entity", NAME_PATTERN)]
    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)), lambda m: F.struct(F.lit(label).alias("label"), m.alias("raw"))) for label, p in labelled)))  # noqa: B023
    rows = texts.select(key, F.posexplode(found).alias("pos", "_f")).select(key, "pos", entity_name("_f.raw").alias("name"), F.col("_f.label").alias("label"), F.col("_f.raw").alias("raw"))
    return rows.groupBy(key, "name", "label").agg(F.min(F.struct("pos", "raw")).alias("_f")).select(key, "_f.pos", "name", "label", "_f.raw")


def label_dictionary(finds: DataFrame, limit: int = 30) -> DataFrame:
    """(label, n): the most frequent labels without those of relations and of bare matches."""
    rows = finds.where(~F.contains("label", F.lit("<>")) & (F.lower("label") != "match")).groupBy("label").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "label").limit(limit)


def accumulated(existing: DataFrame, incoming: DataFrame, sections: int = 20) -> DataFrame:
    """Co-occurrences (book_id, a, b, n, sections) merged into those that exist: counts are added and sections joined, as in the model, so that
    loading twice counts twice. `cooccurrence` over all mentions is the form that doesn't."""
    both = existing.unionByName(incoming)
    return both.groupBy("book_id", "a", "b").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("sections")))), 1, sections).alias("sections"))


def table_nodes(chunk: DataFrame) -> DataFrame:
    """(book_id, id, title, headers, row_count, section): a node for each table, merged over its chunks in their order: the first headers, the last title and number of rows."""
    rows = chunk.where("type = 'table'").select("book_id", "chunk_id", "chunk_seq", "section_path", "headers", F.coalesce(F.size("rows"), F.lit(0)).alias("n_rows")).distinct()
    section = F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.lit(""))
    title = F.when(section == "", "Table").otherwise(F.concat(F.lit("Table: "), section))
    order = F.struct("chunk_seq", "n_rows")
    headers = F.min_by(F.array_join("headers", "|"), F.when(F.col("headers").isNotNull(), order))
    return rows.groupBy("book_id", F.col("chunk_id").alias("id")).agg(F.max_by(title, order).alias("title"), headers.alias("headers"), F.max_by("n_rows", order).alias("row_count"), F.min_by(section, order).alias("section"))


def table_row_nodes(rows: DataFrame) -> DataFrame:
    """(book_id, id, parameter, value, unit, row_index): a node for each table row; a row that is loaded again leaves the first as it is."""
    once = rows.select("book_id", "id", "parameter", "value", "unit", "row_index").distinct()
    fields = F.struct("row_index", "parameter", "value", "unit")
    return once.groupBy("book_id", "id").agg(F.min(fields).alias("_r")).select("book_id", "id", "_r.parameter", "_r.value", "_r.unit", "_r.row_index")


def entity_nodes(mentions: DataFrame, spec: DataFrame) -> DataFrame:
    """(book_id, name, type, n): merged entity nodes: of the types a name has the first, `equipment` for those that only specifications name."""
    said = mentions.select("book_id", F.lower("name").alias("name"), F.col("label").alias("type"), F.lit(0).alias("_order"))
    specs = spec.where(F.col("subject").isNotNull()).select("book_id", F.lower("subject").alias("name"), F.lit("equipment").alias("type"), F.lit(1).alias("_order"))
    return said.unionByName(specs).groupBy("book_id", "name").agg(F.min(F.struct("_order", "type"))["type"].alias("type"), F.count("*").alias("n"))


def entity_mentions(sentences: DataFrame) -> DataFrame:
    """(chunk_id, book_id, section, pos, at, name): capitalised words of six letters and more, the stand-in for a recognition model."""
    words = F.regexp_extract_all("sentence", F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    names = F.filter(words, lambda w: w.rlike(ENTITY_PATTERN))
    return sentences.where(F.length("sentence") >= LEAST_SENTENCE).select("chunk_id", "book_id", "section", "pos", F.posexplode(names).alias("at", "name"))


def entities(mentions: DataFrame) -> DataFrame:
    """(book_id, name, n_mentions, n_sections)."""
    return mentions.groupBy("book_id", "name").agg(F.count("*").alias("n_mentions"), F.count_distinct("section").alias("n_sections"))


def cooccurrence(mentions: DataFrame, sections: int = 20) -> DataFrame:
    """(book_id, a, b, n, sections): distinct names of one sentence in pairs, a before b; at most `sections` sections are kept, as the model that this follows does."""
    per = mentions.groupBy("chunk_id", "book_id", "section", "pos").agg(F.sort_array(F.collect_set("name")).alias("_names")).where(F.size("_names") > 1)
    pairs = F.flatten(F.transform("_names", lambda x, i: F.transform(F.slice(F.col("_names"), i + 2, F.size("_names")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    rows = per.select("book_id", "section", F.inline(pairs))
    return rows.groupBy("book_id", "a", "b").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("section")), 1, sections).alias("sections"))


def hierarchy(chunk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (book_id, label, name, first_seq) and edges (book_id, type, src, dst) from the paths of chunks."""
    rows = chunk.where(F.size("section_path") > 0).select("book_id", "chunk_seq", F.slice("section_path", 1, 3).alias("path")).distinct()
    labels = F.array(F.lit("Chapter"), F.lit("Section"), F.lit("Subsection"))
    exploded = rows.select("book_id", "chunk_seq", "path", F.posexplode("path").alias("depth", "name"))
    nodes = exploded.groupBy("book_id", F.get(labels, F.col("depth")).alias("label"), "name").agg(F.min("chunk_seq").alias("first_seq"))
    source = F.when(F.col("depth") == 0, F.col("book_id")).otherwise(F.get("path", F.col("depth") - 1))
    kinds = F.array(F.lit("HAS_CHAPTER"), F.lit("HAS_SECTION"), F.lit("HAS_SUBSECTION"))
    edges = exploded.select("book_id", F.get(kinds, F.col("depth")).alias("type"), source.alias("src"), F.col("name").alias("dst")).distinct()
    return nodes, edges


def next_sections(nodes: DataFrame) -> DataFrame:
    """(book_id, src, dst): consecutive distinct sections in the order in which they are first seen. The window runs over the section names of a
    book, of which there is one row each."""
    order = Window.partitionBy("book_id").orderBy("first_seq", "name")
    return nodes.where("label = 'Section'").select("book_id", F.col("name").alias("src"), F.lead("name").over(order).alias("dst")).where(F.col("dst").isNotNull())


def entity_sections(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(book_id, name, section, label): entities with the section node of that name, else the subsection; none are left out."""
    rows = mentions.select("book_id", "name", "section").distinct()
    node = lambda label: nodes.where(F.col("label") == label).select("book_id", F.col("name").alias("section"), F.lit(label).alias(f"_{label}"))
    joined = rows.join(node("Section"), ["book_id", "section"], "left").join(node("Subsection"), ["book_id", "section"], "left")
    return joined.select("book_id", "name", "section", F.coalesce("_Section", "_Subsection").alias("label")).where(F.col("label").isNotNull())


def table_parents(chunk: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk_id, book_id, parent): tables under the section or subsection above their own, by name; chapters never match."""
    rows = chunk.where("type = 'table' and size(section_path) > 0").select("chunk_id", "book_id", "section_path").distinct()
    name = F.when(F.size("section_path") >= 2, F.try_element_at("section_path", F.lit(-2))).otherwise(F.try_element_at("section_path", F.lit(-1)))
    known = nodes.where("label in ('Section', 'Subsection')").select("book_id", F.col("name").alias("parent")).distinct()
    return rows.select("chunk_id", "book_id", name.alias("parent")).join(known, ["book_id", "parent"])
