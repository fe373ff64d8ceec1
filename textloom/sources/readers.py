"""Readers of text corpora, as DataFrames.

A ``read_*`` function reads files; the ``parse_*`` function behind it takes a table ``path, value`` of
whole files, so the same rules hold for texts that are already in a table.  Documents come as
``path, topic, category, split, istrain, content`` and what the corpus adds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx

#: Topics of the news groups that are read (fixed values).
NEWS_TOPICS = (
    "talk.politics.mideast", "comp.graphics", "soc.religion.christian", "rec.autos",
    "sci.space", "talk.politics.guns", "rec.sport.baseball", "sci.med",
)
#: News-wire topics that a document may get, and those that are read but not kept (fixed values).
WIRE_TOPICS = ("earn", "acq", "money-fx", "grain", "crude", "trade", "interest", "ship", "wheat", "corn")
WIRE_DROPPED = ("wheat", "corn", "other")
#: Rows that one task may sort.
SORTED_ROWS = 100_000
#: Tag groups of a news-wire document (fixed values).
WIRE_GROUPS = ("topics", "places", "people", "orgs", "exchanges", "companies")


def whole_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path, value`` of all files below a folder; bytes that are not UTF-8 are left out, and so is all under hidden folders below it."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    depth = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).depth()
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")).alias("value"))
    return files.filter(~hidden(F.col("path"), depth))


def hidden(path: Column, depth: int = 0) -> Column:
    """Whether a name of the path begins with a dot, after the first ``depth`` names."""
    names = F.filter(F.split(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/"), lambda x: x != "")
    return F.exists(names, lambda x: x.startswith(".")) if not depth else F.exists(F.filter(names, lambda x, i: i >= depth), lambda x: x.startswith("."))


def _folder(path: Column, up: int) -> Column:
    return F.element_at(F.split(path, "/"), -1 - up)


def topic_columns(path: Column) -> list[Column]:
    """The topic is the file's folder, its category what stands before the first dot."""
    return [_folder(path, 1).alias("topic"), F.substring_index(_folder(path, 1), ".", 1).alias("category")]


def with_validation(docs: DataFrame, id_col: str, share: float = 0.2, seed: int = 2000) -> DataFrame:
    """Turns ``istrain`` of the share of training rows that a seeded hash puts first from YES to VALID.

    The cut is the hash value below which ``round(share * n)`` training rows lie, taken from counts of the hash's leading
    digits, three more at a time, until few rows share them; so no task sorts the table.
    """
    key = F.concat(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}"))), F.lit("-"), F.col(id_col).cast("string"))
    train = docs.filter("istrain = 'YES'").select(key.alias("key"))
    wanted, prefix, inside = round(share * train.count()), "", train.count()
    before = 0  # rows that come before those with the prefix
    while inside > SORTED_ROWS:
        counts = train.filter(F.col("key").startswith(prefix)).groupBy(F.substring("key", 1, len(prefix) + 3).alias("d")).count()
        for digits, n in sorted((r["d"], r["count"]) for r in counts.collect()):  # 4,096 at most
            if before + n > wanted:
                prefix, inside = digits, n
                break
            before += n
        else:
            break
        if len(prefix) > 30:  # rows of one id
            break
    near = train.filter(F.col("key").startswith(prefix)).orderBy("key").limit(wanted - before).agg(F.max("key")).first()[0] if wanted > before else None
    valid = (F.col("istrain") == "YES") & ((key <= near) if near is not None else (key < prefix) if prefix else F.lit(wanted > 0))
    return docs.withColumn("istrain", F.when(valid, "VALID").otherwise(F.col("istrain")))


def parse_newsgroups(files: DataFrame, topics: tuple[str, ...] = NEWS_TOPICS) -> DataFrame:
    """Mails in ``<anything>-<split>/<topic>/<file>``; header, footer, then quotes are stripped."""
    split = F.element_at(F.split(_folder(F.col("path"), 2), "-"), -1)
    content = tx.without_quotes(tx.without_footer(tx.without_header(F.col("value"))))
    rows = files.select("path", *topic_columns(F.col("path")), split.alias("split"), content.alias("content"))
    return rows.filter(F.col("topic").isin(*topics)).withColumn("istrain", F.when(F.lower("split") == "train", "YES").otherwise("NO"))


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf'(?i)\b{name}\s*=\s*"([^"]*)"', 1)
    return F.when(tag.rlike(rf'(?i)\b{name}\s*=\s*"'), found)


def _inside(text: Column, tag: str) -> Column:
    """The first element's content, null without one."""
    return F.when(text.rlike(rf"(?is)<{tag}\b[^>]*>.*?</{tag}>"), F.regexp_extract(text, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))


def parse_newswire(files: DataFrame, interesting: tuple[str, ...] = WIRE_TOPICS, dropped: tuple[str, ...] = WIRE_DROPPED) -> DataFrame:
    """``newid, title, content, topic, istrain, metadata, tags`` of ``<REUTERS>`` elements.

    Elements without the split's attributes, not used by it, or without topics by it are left out.  The topic is the
    first of the element's that is interesting, else ``other``; ``tags`` are (category, name) of all six groups.
    """
    elements = files.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)(<REUTERS\b.*?</REUTERS>)"), 1)).alias("e"))
    head = F.regexp_extract("e", r"(?is)^(<REUTERS\b[^>]*>)", 1)
    names = ("newid", "oldid", "topics", "cgisplit", "lewissplit")
    rows = elements.select("e", *[_attribute(head, n).alias(n) for n in names]).dropna(subset=list(names))
    rows = rows.filter((F.col("lewissplit") != "NOT-USED") & ~F.col("topics").isin("NO", "BYPASS"))

    def listed(group: str) -> Column:
        return F.transform(F.regexp_extract_all(F.coalesce(_inside(F.col("e"), group), F.lit("")), F.lit(r"(?is)<D>(.*?)</D>"), 1), lambda x: F.trim(x))

    def tagged(group: str) -> Column:
        return F.transform(listed(group), lambda x: F.struct(F.lit(group).alias("category"), x.alias("name")))

    tags = F.concat(*[tagged(g) for g in WIRE_GROUPS])
    first = F.coalesce(F.get(F.filter(listed("topics"), lambda x: x.isin(*interesting)), F.lit(0)), F.lit("other"))
    metadata = F.concat(F.lit("OLDID:"), "oldid", F.lit("^TOPICS:"), "topics", F.lit("^CGISPLIT:"), "cgisplit", F.lit("^LEWISSPLIT:"), "lewissplit")
    found = rows.select(
        "newid", tx.html_text(_inside(F.col("e"), "title")).alias("title"), tx.html_text(_inside(F.col("e"), "text")).alias("content"), first.alias("topic"),
        F.when(F.lower("lewissplit") == "train", "YES").otherwise("NO").alias("istrain"), metadata.alias("metadata"), tags.alias("tags"),
    )
    return found.filter(~F.col("topic").isin(*dropped))


def document_tags(docs: DataFrame) -> DataFrame:
    """``newid, category, name``: one row a tag."""
    return docs.select("newid", F.explode("tags").alias("t")).select("newid", "t.category", "t.name").distinct()


def parse_gold_summaries(files: DataFrame) -> DataFrame:
    """``filename, summarizer, summary, words`` of ``<SUM docref summarizer>`` elements, one for each document and summarizer."""
    elements = files.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)(<SUM\b.*?</SUM>)"), 1)).alias("e"))
    head = F.regexp_extract("e", r"(?is)^(<SUM\b[^>]*>)", 1)
    text = F.trim(F.regexp_replace(tx.html_text(F.col("e")), r"^\s+|\s+$", ""))
    rows = elements.select(_attribute(head, "docref").alias("filename"), _attribute(head, "summarizer").alias("summarizer"), text.alias("summary"))
    rows = rows.withColumn("words", word_count(F.col("summary")))
    return rows.groupBy("filename", "summarizer").agg(F.min(F.struct("summary", "words")).alias("s")).select("filename", "summarizer", "s.summary", "s.words")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def parse_summarised_documents(files: DataFrame, gold: DataFrame, least_words: int = 100, most_stops: int = 1000) -> DataFrame:
    """``filename, content`` of documents that a long enough gold summary names: with a text of enough words, and one to ``most_stops`` full stops; each name once."""
    named = files.select(_folder(F.col("path"), 0).alias("filename"), F.regexp_replace(tx.html_text(_inside(F.col("value"), "text")), r"^\s+|\s+$", "").alias("content"))
    stops = F.length("content") - F.length(F.replace("content", F.lit("."), F.lit("")))
    kept = named.dropna().filter(stops.between(1, most_stops) & (word_count(F.col("content")) >= least_words))
    wanted = gold.filter(F.col("words") >= least_words).select("filename").distinct()
    return kept.join(wanted, "filename", "left_semi").groupBy("filename").agg(F.min("content").alias("content"))


def gold_of_documents(gold: DataFrame, documents: DataFrame, method_id: int = 20) -> DataFrame:
    kept = gold.join(documents.select("filename"), "filename", "left_semi")
    return kept.select("filename", "summary", F.lit(method_id).alias("method_id"), F.concat(F.lit("SUMMARIZER:"), "summarizer").alias("metadata"))


def parse_reviews(files: DataFrame) -> DataFrame:
    """Reviews with mark-up in ``<split>/<topic>/<file>``; unlabelled ones of the test part are left out, those of training are MAYBE."""
    rows = files.select("path", *topic_columns(F.col("path")), _folder(F.col("path"), 2).alias("split"), tx.html_text(F.col("value")).alias("content"))
    train = F.lower("split") == "train"
    istrain = F.when(train & (F.col("topic") == "unsup"), "MAYBE").when(train, "YES").otherwise("NO")
    return rows.filter(~((F.col("split") == "test") & (F.col("topic") == "unsup"))).withColumn("istrain", istrain)


def parse_line_reviews(files: DataFrame) -> DataFrame:
    """One review a line (``line_no`` from 0) in ``<split>/<topic>/<file>``."""
    rows = files.select("path", *topic_columns(F.col("path")), _folder(F.col("path"), 2).alias("split"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "content"))
    return rows.withColumn("istrain", F.when(F.lower("split") == "train", "YES").otherwise("NO"))


def delimited(files: DataFrame, separator: str, names: list[str], skip_header: bool = True) -> DataFrame:
    """Lines parted at the first ``len(names) - 1`` separators; lines with fewer are left out."""
    lines = files.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    lines = lines.filter(F.col("n") >= int(skip_header)).select(F.split("line", separator, len(names)).alias("f")).filter(F.size("f") == len(names))
    return lines.select(*[F.trim(F.col("f")[i]).alias(n) for i, n in enumerate(names)])


def parse_pairs(files: DataFrame) -> DataFrame:
    """``pair_id, sent1, sent2, score, split`` of tab-separated lines: sentences second and third, the score fifth, the split last."""
    lines = files.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).filter("n > 0").select("n", F.split(F.trim("line"), "\t").alias("f"))
    return lines.filter(F.size("f") >= 5).select(
        F.col("f")[0].alias("pair_id"), F.col("f")[1].alias("sent1"), F.col("f")[2].alias("sent2"), F.col("f")[4].cast("double").alias("score"), F.trim(F.element_at("f", -1)).alias("split")
    )


def pair_documents(pairs: DataFrame) -> DataFrame:
    """``pair_id, side, content, topic``: two documents a pair."""
    return pairs.select("pair_id", F.posexplode(F.array("sent1", "sent2")).alias("side", "content"), F.col("split").alias("topic"))


def istrain_code(code: Column) -> Column:
    return F.when(code == 1, "YES").when(code == 2, "NO").otherwise("VALID")


def sentiment_class(value: Column, ways: int) -> Column:
    """Right-closed bins: two classes with the middle fifth null, or five."""
    if ways == 2:
        return F.when(value <= 0.4, "ng").when(value > 0.6, "pos")
    return F.when(value <= 0.2, "vng").when(value <= 0.4, "ng").when(value <= 0.6, "ntrl").when(value <= 0.8, "pos").otherwise("vpos")


def parse_treebank(splits: DataFrame, sentences: DataFrame, sentiments: DataFrame, ways: int = 2) -> DataFrame:
    """``id, content, topic, istrain`` of the three files ``id,split``, ``id TAB sentence`` and ``id TAB value`` (the last without a header)."""
    s = delimited(splits, ",", ["id", "code"]).select(F.col("id").cast("long").alias("id"), istrain_code(F.col("code").cast("int")).alias("istrain"))
    t = delimited(sentences, "\t", ["id", "content"]).withColumn("id", F.col("id").cast("long"))
    v = delimited(sentiments, "\t", ["id", "value"], skip_header=False).select(F.col("id").cast("long").alias("id"), sentiment_class(F.col("value").cast("double"), ways).alias("topic"))
    return t.join(s, "id").join(v.dropna(), "id").select("id", "content", "topic", "istrain")


def parse_vectors(lines: DataFrame) -> DataFrame:
    """``term, v`` of lines ``term x1 ... xd`` (column ``value``); a header ``n d`` is left out."""
    f = F.split(F.trim("value"), r"\s+")
    return lines.select(f.alias("f")).filter((F.size("f") > 2)).select(F.col("f")[0].alias("term"), F.transform(F.slice("f", F.lit(2), F.size("f") - 1), lambda x: x.cast("double")).alias("v"))


def star_edges(lexicon: DataFrame) -> DataFrame:
    """``src, dst``: the first word of each line (``tokens``) with each of the others, lower-cased, once."""
    return lexicon.select(F.lower(F.col("tokens")[0]).alias("src"), F.explode(F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0)))).alias("d")).select("src", F.lower("d").alias("dst")).distinct()


def read_newsgroups(spark: SparkSession, path: str) -> DataFrame:
    return with_validation(parse_newsgroups(whole_files(spark, path)), "path")


def read_newswire(spark: SparkSession, path: str) -> DataFrame:
    return with_validation(parse_newswire(whole_files(spark, path, "*.sgm")), "newid")


def read_summarised(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a tree whose files named ``perdocs`` hold the summaries."""
    files = whole_files(spark, path)
    is_gold = _folder(F.col("path"), 0).startswith("perdocs")
    return parse_summarised_documents(files.filter(~is_gold), parse_gold_summaries(files.filter(is_gold)))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return with_validation(parse_reviews(whole_files(spark, path)), "path")


def read_line_reviews(spark: SparkSession, path: str) -> DataFrame:
    return parse_line_reviews(whole_files(spark, path))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return parse_pairs(whole_files(spark, path))


def read_treebank(spark: SparkSession, path: str, ways: int = 2) -> DataFrame:
    return parse_treebank(*[whole_files(spark, f"{path}/{name}") for name in ("datasetSplit.txt", "datasetSentences.txt", "sent_sentiment.txt")], ways)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_vectors(spark.read.text(path))


def read_jdbc(spark: SparkSession, connection: str, table: str, kind: str = "postgresql", **options: str) -> DataFrame:
    """A table of a database named by ``db,user,password,host,port``."""
    db, user, password, host, port = connection.split(",")
    return spark.read.jdbc(f"jdbc:{kind}://{host}:{port}/{db}", table, properties={"user": user, "password": password, **options})


#: Data sets by name.
READERS: dict[str, Callable[..., DataFrame]] = {
    "news": read_newsgroups, "reuter": read_newswire, "duc": read_summarised, "imdb": read_reviews,
    "rt": read_line_reviews, "sick": read_pairs, "treebank": read_treebank, "vectors": read_vectors,
}


def read(spark: SparkSession, dataset: str, path: str, **options) -> DataFrame:
    if dataset not in READERS:
        raise ValueError(f"unknown data set {dataset!r}; known are {', '.join(sorted(READERS))}")
    return READERS[dataset](spark, path, **options)
