"""Line classes and paragraphs against a plain automaton that reads a page line by line."""

import random
import re

from corpuseval.operators import lines as ln

PIECES = (
    "", "", "  ", "7", "12-34", "Page 3", "page 12", "3 of 9", "Page 3 of 9 and more", "412", "9999", "12345", "1.5, 2", "a b", "x", "TABLE 2", "Table manners of guests at long dinners", "figure iv", "Quadrant II", "QUADRANT 4",
    "ABSTRACT", "Introduction and aims of the work that follows here", "methods", "A LONG HEADING IN CAPITALS", "A HEADING OF CAPITALS IN MORE THAN THIRTY", "RESULTS 2020;", "© 2019 Some Press", "doi:10.1000/182", "DOI 10.1 x", "3 | Author",
    "see wileyonlinelibrary.com for it", "J SOC 2001;4", "col\tcol col col", "    an indented sentence that goes on for a while,", "a   b   c d e f", "The quick brown fox jumps over the lazy dog and then it ends.",
    "The quick brown fox jumps over the lazy dog and does not end", "lower case goes on from the line above it here", "a word is cut off at the end of this longer li-", "more of them;", "what now?", "中文的句子在这里结束。", "中文的句子在这里继续，", "Łódź is upper at the start of this sentence",
    "éa lower start with an accent in a longer line", "wide　space", " padded by other spaces and long enough to be text ", "tail-", "SHORT CAPS", "Ünder 30 chars", "words of three", "12 Page", "٣٤", "state of the art - ", "2 of", "(c) 2020",
)


class Automaton:
    """One line after another; what is open, what came before, and whether a page number was seen."""

    HEADS = ("abstract", "keywords", "introduction", "conclusion", "references", "acknowledgments", "appendix", "results", "discussion", "methods", "methodology")

    def __init__(self, text):
        self.lines = [x.strip() for x in text.split("\n")]
        self.table = set()
        run = []
        for k, x in enumerate([*self.lines, ""]):
            if self.like(x):
                run.append(k)
                continue
            self.table |= set(run) if len(run) > 2 else set()
            run = []
        self.seen, self.before, self.open, self.done, self.kinds = False, "", None, [], []
        for k, x in enumerate(self.lines):
            self.kinds.append(self.take(k, x))
        self.close()

    @staticmethod
    def like(x):
        if not 0 < len(x) < 51:
            return False
        short = len(x) < 30 and (x.isupper() or len(x.split()) < 4)
        return bool(short or re.match(r"(table|figure|quadrant)\s+[ivx\d]", x, re.I | re.A) or re.fullmatch(r"[\d\s.,]+", x) or re.search(r"\t|\s\s\s", x))

    def number(self, x, in_zone):
        if self.seen or len(x) > 50 or not in_zone or not re.fullmatch(r"\d{1,4}|\d+[-/]\d+|page\s+\d+|\d+\s*of\s*\d+", x, re.I):
            return False
        self.seen = True
        return True

    @staticmethod
    def footer(x):
        return len(x) < 51 and bool(len(x) < 5 or re.match(r"\d+$|page\s+\d|\d+\s+\||[a-z\s]+\d{4};", x, re.I) or re.search(r"wileyonlinelibrary\.com|©.*\d{4}", x, re.I))

    def special(self, x):
        return bool(re.match(r"(table|figure)\s+\d|quadrant\s+[ivx]", x, re.I)) or (x.isupper() and 10 < len(x) < 100) or x.lower().startswith(self.HEADS)

    def close(self, *more):
        if self.open is not None:
            self.done.append(self.open)
        self.open = None
        self.done += more

    def take(self, k, x):
        zone = k < 5 or k >= len(self.lines) - 5
        if not x:
            self.close()
            self.before = ""
            return "blank"
        if self.number(x, zone):
            self.close(f"[Journal Page: {x}]")
            self.before = ""
            return "page_number"
        if zone and k not in self.table and self.footer(x):
            if "©" in x or "DOI" in x.upper():
                self.close(f"[Metadata: {x}]")
                self.before = ""
            return "header_footer"
        if self.special(x):
            self.close(x)
            self.before = x
            return "special"
        b, table = self.before, k in self.table
        if b and not table and b[-1] not in "-,;:，；：.!?。！？" and not x[0].islower():
            self.number(x, True)  # the rule that asks whether a sentence goes on takes a number for that of the page
        if self.open is None:
            self.open = x
        elif b.endswith("-"):
            self.open = self.open[:-1] + x
        elif not table and b[-1] in ".!?。！？" and not x[0].islower():
            self.close()
            self.open = x
        else:
            self.open += " " + x
        self.before = x
        return "text"


def random_page(rng):
    return "\n".join(rng.choice(PIECES) + rng.choice(["", "", "", " ", ".", "\t"]) for _ in range(rng.choice([1, 2, 6, 12, 25, 40])))


def test_thousand_random_pages(spark):
    rng = random.Random(5)
    pages = {k: random_page(rng) for k in range(1000)}
    df = spark.createDataFrame(list(pages.items()), "id int, text string")
    classed = ln.line_class(ln.explode_lines(df, "id", "text"), "id").cache()
    want = {k: Automaton(p) for k, p in pages.items()}
    kinds = {}
    for r in classed.orderBy("id", "line_no").collect():
        kinds.setdefault(r.id, []).append((r.kind, r.in_table))
    for k, page in pages.items():
        assert kinds[k] == [(kind, n in want[k].table) for n, kind in enumerate(want[k].kinds)], page
    paragraphs = ln.restore_paragraphs(classed, "id").cache()
    got = {}
    for r in paragraphs.orderBy("id", "paragraph_no").collect():
        got.setdefault(r.id, []).append(r.paragraph)
        assert r.paragraph_no == len(got[r.id])
    assert {k: got.get(k, []) for k in pages} == {k: w.done for k, w in want.items()}
    texts = {r.id: r.text for r in ln.restored_text(paragraphs, "id").collect()}
    assert {k: texts.get(k, "") for k in pages} == {k: "\n\n".join(w.done) for k, w in want.items()}


def test_rules_of_lines(spark):
    cases = {"  an indented line of words": False, "Table manners of guests": False, "1.5, 20": True, "TWENTY FIVE CAPITAL LETTERS": True, "TABLE IV of all the words in a line": True, "a\tb c d": True, "one two three": True, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    assert {r.line: r.v for r in df.select("line", ln.table_like("line").alias("v")).collect()} == cases


def test_null_and_empty_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "only one line of text that stands for itself")], "id int, text string")
    classed = ln.line_class(ln.explode_lines(df, "id", "text"), "id")
    assert [tuple(r) for r in ln.restore_paragraphs(classed, "id").collect()] == [(3, 1, "only one line of text that stands for itself")]
    assert ln.restore_paragraphs(ln.line_class(ln.explode_lines(df.limit(0), "id", "text"), "id"), "id").count() == 0
