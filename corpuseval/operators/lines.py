"""Lines of page text: tables, headers, and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuseval.functions.textkeys import SPACE, clean_text, stripped

# Marks of journal pages.
ZONE = 5  # lines at the head and tail of a page
SHORT = 50  # characters of a table line, a page number, a header or a footer at most
SECTIONS = ("abstract", "acknowledgments", "appendix", "conclusion", "discussion", "introduction", "keywords", "methodology", "methods", "references", "results")
PAGE_NUMBER = rf"(?i)^(\p{{Nd}}{{1,4}}|\p{{Nd}}+[-/]\p{{Nd}}+|Page{SPACE}+\p{{Nd}}+|\p{{Nd}}+{SPACE}*of{SPACE}*\p{{Nd}}+)$"
FOOTER = rf"(?is)(^\p{{Nd}}+$|^Page{SPACE}+\p{{Nd}}|^\p{{Nd}}+{SPACE}+\||wileyonlinelibrary\.com|©.*\p{{Nd}}{{4}}|^([A-Z]|{SPACE})+\p{{Nd}}{{4}};)"
TABLE_HEAD = rf"(?i)^(table|figure|quadrant){SPACE}+[IVX0-9]"
TABLE_MARK = rf"(?i)^((table|figure){SPACE}+\p{{Nd}}|quadrant{SPACE}+[IVX])"
SENTENCE_END, GOES_ON = "[.!?。！？]$", "[,;:，；：]$"
UPPER, LOWER = r"\p{IsUppercase}", r"[\p{IsLowercase}\p{Lt}]"


def explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """K1. (key, line_no from 0, line, n_lines)."""
    return df.withColumn("_lines", F.split(text, "\n")).select(key, F.size("_lines").alias("n_lines"), F.posexplode("_lines").alias("line_no", "line"))


def _is_upper(t: Column) -> Column:
    return t.rlike(UPPER) & ~t.rlike(LOWER)


def table_like(line: Column | str) -> Column:
    """K2. Whether a line may be of a table: at most 50 characters and the head of a table, digits with points and commas, fewer than 30 capitals, three words or fewer, or a gap."""
    t = stripped(line)
    words = F.size(F.split(t, f"{SPACE}+"))
    some = t.rlike(TABLE_HEAD) | t.rlike(rf"^([\p{{Nd}}.,]|{SPACE})+$") | ((F.length(t) < 30) & (_is_upper(t) | (words <= 3))) | t.rlike(rf"\t|{SPACE}{{3,}}")
    return (t != "") & (F.length(t) <= SHORT) & some


def table_regions(lines: DataFrame, key: str, at_least: int = 3) -> DataFrame:
    """K3. First and last line of each run of table-like lines."""
    hits = lines.where(table_like("line")).withColumn("_island", F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no")))
    return hits.groupBy(key, "_island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).where(F.col("last_line") - F.col("first_line") + 1 >= at_least).drop("_island")


def in_tables(lines: DataFrame, key: str, at_least: int = 3) -> DataFrame:
    """``in_table`` of each line: whether a region of ``table_regions`` holds it, runs are numbered by a running sum of their edges."""
    order = Window.partitionBy(key).orderBy("line_no")
    like, before = table_like("line"), F.lag("_like", 1, False).over(order)
    rows = lines.withColumn("_like", like).withColumn("_run", F.sum((F.col("_like") != before).cast("int")).over(order))
    length = F.count("*").over(Window.partitionBy(key, "_run"))
    return rows.withColumn("in_table", F.col("_like") & (length >= at_least)).drop("_like", "_run")


def _previous(kind: Column, key: str) -> Column:
    """What the last line before this one that counts has left: its text, or an empty text after blanks, page numbers and metadata."""
    t, order = F.col("_t"), Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    metadata = t.contains("©") | F.upper(t).contains("DOI")
    left = F.when((kind == "header_footer") & ~metadata, None).when(kind.isin("special", "text"), t).otherwise("")
    of_text = F.when(left.isNotNull(), kind == "text")
    return F.struct(F.coalesce(F.last(left, True).over(order), F.lit("")).alias("line"), F.coalesce(F.last(of_text, True).over(order), F.lit(False)).alias("is_open"))


def line_class(lines: DataFrame, key: str) -> DataFrame:
    """K4. ``kind`` of each line: blank, page_number, header_footer, special or text, and whether it is ``in_table``.

    A page has one page number at most, the first line of the head or tail that looks like one, unless a line between them that looks like one has
    been asked before: one that follows a line without an end, where the sentence might go on.  All other rules look at a line and its place.
    So the first line of either sort is found as if no number had been seen, which holds up to there, and kinds follow from it.
    """
    t, order = F.col("_t"), Window.partitionBy(key)
    rows = in_tables(lines.withColumn("_t", stripped("line")), key)
    short = F.length(t) <= SHORT
    zone = (F.col("line_no") < ZONE) | (F.col("line_no") >= F.col("n_lines") - ZONE)
    number, like_footer = short & t.rlike(PAGE_NUMBER), short & ((F.length(t) < 5) | t.rlike(FOOTER))
    special = t.rlike(TABLE_MARK) | (_is_upper(t) & F.length(t).between(11, 99)) | F.lower(t).rlike(f"^({'|'.join(SECTIONS)})")
    rows = rows.withColumns({"_number": number, "_zone": zone, "_footer": zone & like_footer & ~F.col("in_table"), "_special": special})

    def kinds(is_page_number: Column) -> Column:
        return F.when(t == "", "blank").when(is_page_number, "page_number").when(F.col("_footer"), "header_footer").when(F.col("_special"), "special").otherwise("text")

    rows = rows.withColumn("_kind", kinds(F.col("_zone") & F.col("_number")))
    rows = rows.withColumn("_before", _previous(F.col("_kind"), key)["line"])
    cut_off = (F.col("_before") != "") & ~F.col("_before").rlike("-$") & ~F.col("_before").rlike(GOES_ON) & ~F.col("_before").rlike(SENTENCE_END)
    asked = ~F.col("_zone") & (F.col("_kind") == "text") & ~F.col("in_table") & ~t.rlike(r"^\p{IsLowercase}") & cut_off
    first = F.min(F.when(F.col("_number") & (F.col("_zone") | asked), F.col("line_no"))).over(order)
    kind = kinds(F.col("_zone") & F.col("_number") & (F.col("line_no") == first))
    return rows.withColumn("kind", kind).drop("_t", "_number", "_zone", "_footer", "_special", "_kind", "_before")


def restore_paragraphs(classed: DataFrame, key: str) -> DataFrame:
    """K5. (key, paragraph_no, paragraph): broken lines joined again.

    Page numbers, and headers and footers with a copyright or identifier, are bracketed paragraphs of their own; other headers and footers go
    and leave no trace, so a sentence may go on after them.  Special lines are paragraphs.  A line of text starts a paragraph after any of
    these, after a blank, and where the line before ends a sentence and it does not start in lower case, outside tables.  A line before
    that ends in a hyphen loses it and is joined without a space.
    """
    t, order = F.col("_t"), Window.partitionBy(key).orderBy("line_no")
    rows = classed.withColumn("_t", stripped("line")).withColumn("_before", _previous(F.col("kind"), key))
    before = F.col("_before.line")
    marked = F.when(F.col("kind") == "page_number", F.concat(F.lit("[Journal Page: "), t, F.lit("]"))).when(F.col("kind") == "header_footer", F.concat(F.lit("[Metadata: "), t, F.lit("]"))).otherwise(t)
    kept = (F.col("kind") != "blank") & ((F.col("kind") != "header_footer") | t.contains("©") | F.upper(t).contains("DOI"))
    starts = (F.col("kind") != "text") | ~F.col("_before.is_open") | (~F.col("in_table") & before.rlike(SENTENCE_END) & ~t.rlike(r"^\p{IsLowercase}"))
    rows = rows.withColumns({"_starts": starts, "_piece": marked, "_halved": ~starts & before.rlike("-$")}).where(kept)
    rows = rows.withColumn("_p", F.sum(F.col("_starts").cast("int")).over(order))
    halved_next = F.lead("_halved", 1, False).over(Window.partitionBy(key, "_p").orderBy("line_no"))
    piece = F.when(halved_next, F.regexp_replace("_piece", "-$", "")).otherwise(F.col("_piece"))
    rows = rows.withColumn("_piece", F.when(F.col("_starts") | F.col("_halved"), piece).otherwise(F.concat(F.lit(" "), piece)))
    joined = rows.groupBy(key, F.col("_p").cast("int").alias("paragraph_no")).agg(F.array_sort(F.collect_list(F.struct("line_no", "_piece"))).alias("_lines"))
    return joined.select(key, "paragraph_no", F.array_join(F.transform("_lines", lambda x: x["_piece"]), "").alias("paragraph"))


def restored_text(paragraphs: DataFrame, key: str) -> DataFrame:
    """(key, text): the paragraphs of a page with a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("paragraph_no", "paragraph")))
    return paragraphs.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p["paragraph"]), "\n\n").alias("text"))


def join_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """K6. Pages in order as one clean text; ``status`` is failed where that is empty."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda p: p[text])
    whole = pages.groupBy(doc).agg(clean_text(F.array_join(ordered, "\n\n")).alias("content"))
    return whole.withColumn("status", F.when(F.col("content") == "", "failed").otherwise("content_parsed"))
