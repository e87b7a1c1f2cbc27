"""Text expressions: tokens, HTML → markdown, chunking, classification input,
keyword rules, prompt templates. All are built-in Spark expressions, so they run
in the JVM (regex steps inside whole-stage code generation; higher-order array
functions are evaluated beside it).

Every regex here uses only syntax that Java and RE2 read the same way, so the
oracle SQL can apply the same patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- tokens -----------------------------------------------------------------

# Fixed value: a token is a maximal run of letters and digits, lower-cased.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(col: str | Column) -> Column:
    """Lower-cased tokens, empty strings dropped (array<string>)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_remove(F.split(F.lower(c), TOKEN_SPLIT), "")


def sql_tokens(expr: str) -> str:
    """DuckDB form of :func:`tokens`."""
    return f"list_filter(regexp_split_to_array(lower({expr}), '{TOKEN_SPLIT}'), lambda t: length(t) > 0)"


# English stop words dropped from theme terms.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in",
    "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were",
    "will", "with", "not", "but", "they", "we", "you", "your", "our", "their",
)

# --- HTML → markdown ------------------------------------------------------------

# Blocks removed whole (tag, optional attribute pattern).
DROP_BLOCKS = ("head", "script", "style", "nav", "footer", "aside")
AD_BLOCK = r'(?is)<div[^>]*class="[^"]*\bad\b[^"]*"[^>]*>.*?</div>'
# HTML entities decoded; "&amp;" last so nothing decodes twice.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))

# (pattern, replacement) in application order; replacements hold no group refs.
_HTML_STEPS: list[tuple[str, str]] = (
    [(r"(?s)<!--.*?-->", " ")]
    + [(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", " ") for t in DROP_BLOCKS]
    + [(AD_BLOCK, " ")]
    + [(rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)]
    + [(r"(?i)</h[1-6]\s*>", "\n\n"),
       (r"(?i)<li\b[^>]*>", "\n- "),
       (r"(?i)<br\s*/?>", "\n"),
       (r"(?i)</?(p|div|article|section|ul|ol|table|tr)\b[^>]*>", "\n\n"),
       (r"<[^>]*>", ""),
       (r"[ \t]+", " "),
       (r" ?\n ?", "\n"),
       (r"\n{3,}", "\n\n")]
)


# Leading/trailing whitespace including line breaks (Java and RE2 agree on this class).
_EDGE_SPACE = r"^[ \t\r\n]+|[ \t\r\n]+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_SPACE, F.lit(""))


def _unescape(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def html_title(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return _strip(_unescape(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_to_markdown(col: str | Column) -> Column:
    """Markdown-like text of a page: boilerplate blocks dropped, headings as
    ``#``, list items as ``- ``, paragraphs separated by a blank line,
    entities decoded. NULL stays NULL."""
    c = F.col(col) if isinstance(col, str) else col
    for pattern, repl in _HTML_STEPS:
        c = F.regexp_replace(c, pattern, F.lit(repl))
    return _strip(_unescape(c))


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_html_to_markdown(expr: str) -> str:
    out = expr
    for pattern, repl in _HTML_STEPS:
        out = f"regexp_replace({out}, {_sql_str(pattern)}, {_sql_repl(repl)}, 'g')"
    for ent, ch in ENTITIES:
        out = f"replace({out}, {_sql_str(ent)}, {_sql_str(ch)})"
    return f"regexp_replace({out}, {_sql_str(_EDGE_SPACE)}, '', 'g')"


def _sql_repl(repl: str) -> str:
    return "'" + repl.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if "\n" in repl else _sql_str(repl)


def sql_html_title(expr: str) -> str:
    out = f"regexp_extract({expr}, {_sql_str('(?is)<title[^>]*>(.*?)</title>')}, 1)"
    for ent, ch in ENTITIES:
        out = f"replace({out}, {_sql_str(ent)}, {_sql_str(ch)})"
    return f"regexp_replace({out}, {_sql_str(_EDGE_SPACE)}, '', 'g')"


# --- chunking ---------------------------------------------------------------

# Chunk size and overlap of the reference's splitter call.
CHUNK_SIZE = 1500
CHUNK_OVERLAP = 100


def fixed_chunks(col: str | Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` characters starting every ``size - overlap``
    characters, until a window reaches the end (array<string>)."""
    c = F.col(col) if isinstance(col, str) else col
    step = size - overlap
    n = F.greatest(F.lit(0), F.ceil((F.length(c) - F.lit(size)) / F.lit(step))).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.substring(c, k * step + 1, size))


def sql_fixed_chunk_count(expr: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> str:
    step = size - overlap
    return f"greatest(0, CAST(ceil((length({expr}) - {size}) / {step}.0) AS BIGINT))"


def line_chunks(col: str | Column, size: int = CHUNK_SIZE) -> Column:
    """Pack whole lines greedily into chunks of at most ``size`` characters
    (joined by a newline); a line longer than ``size`` is cut into pieces of
    ``size``. No overlap. A fold over the lines (``aggregate``)."""
    c = F.col(col) if isinstance(col, str) else col
    lines = F.split(c, "\n")
    pieces = F.flatten(F.transform(
        lines,
        lambda line: F.transform(
            F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(line) / F.lit(size)).cast("int") - 1)),
            lambda k: F.substring(line, k * size + 1, size))))
    init = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def step(acc, piece):
        fits = acc["cur"].isNotNull() & (F.length(acc["cur"]) + 1 + F.length(piece) <= size)
        return F.when(acc["cur"].isNull(), F.struct(acc["done"].alias("done"), piece.alias("cur"))) \
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit("\n"), piece).alias("cur"))) \
            .otherwise(F.struct(F.array_append(acc["done"], acc["cur"]).alias("done"), piece.alias("cur")))

    return F.aggregate(pieces, init, step,
                       lambda acc: F.when(acc["cur"].isNull(), acc["done"])
                       .otherwise(F.array_append(acc["done"], acc["cur"])))


# Markdown separators of the recursive splitter, coarsest first, as
# (pattern, text before the cut, text after it): headings, paragraphs, lines,
# sentences, words.
MARKDOWN_CUTS = ((r"\n(#{1,6} )", "\n", "$1"), (r"\n\n", "\n\n", ""), (r"\n", "\n", ""), (r"\. ", ". ", ""), (" ", " ", ""))
_CUT, _DONE = "\x01", "\x02"


def recursive_chunks(col: str | Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Recursive character splitting (array<string>): whatever is too long is cut at
    the coarsest separator, its parts at the next finer one, and so on, at last
    into plain windows; the parts are packed in order, and every chunk but the
    first begins with the last ``overlap`` characters of the packed text before
    it. A chunk has at most ``size`` characters; blank ones are dropped."""
    c = F.col(col) if isinstance(col, str) else col
    limit = size - overlap

    def cut(pattern: str, before: str, after: str):
        return lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(
            F.split(F.regexp_replace(p, pattern, before + _CUT + after), _CUT))

    def windows(p):
        n = F.greatest(F.lit(1), F.ceil(F.length(p) / F.lit(limit)).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(p, k * limit + 1, limit))

    pieces = F.array(c)
    for how in MARKDOWN_CUTS:
        pieces = F.flatten(F.transform(pieces, cut(*how)))
    pieces = F.filter(F.flatten(F.transform(pieces, windows)), lambda p: F.length(p) > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, p):
        return F.when(F.length(acc["cur"]) + F.length(p) <= limit,
                      F.struct(acc["done"].alias("done"), F.concat(acc["cur"], p).alias("cur"))) \
            .otherwise(F.struct(F.array_append(acc["done"], acc["cur"]).alias("done"), p.alias("cur")))

    packed = F.aggregate(pieces, start, step, lambda acc: F.array_append(acc["done"], acc["cur"]))
    tails = F.transform(packed, lambda p: F.right(p, F.lit(overlap)))
    chunks = F.zip_with(F.concat(F.array(F.lit("")), F.slice(tails, 1, F.size(tails) - 1)), packed, lambda t, p: F.concat(t, p))
    return F.filter(F.transform(chunks, lambda x: F.regexp_replace(x, _EDGE_SPACE, "")), lambda x: F.length(x) > 0)


def sql_recursive_chunks(expr: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> str:
    """DuckDB form of :func:`recursive_chunks` (a list expression)."""
    limit, pieces = size - overlap, f"[{expr}]"

    def text(s: str) -> str:
        return " || ".join({"\n": "chr(10)"}.get(x, f"'{x}'") for x in s) if s else "''"

    for pattern, before, after in MARKDOWN_CUTS:
        repl = f"{text(before)} || chr(1) || '{after.replace('$', chr(92))}'"
        pieces = (f"flatten(list_transform({pieces}, lambda p: CASE WHEN length(p) <= {limit} THEN [p] ELSE "
                  f"string_split(regexp_replace(p, {_sql_str(pattern)}, {repl}, 'g'), chr(1)) END))")
    pieces = (f"list_filter(flatten(list_transform({pieces}, lambda p: list_transform(range(0, greatest(1, "
              f"CAST(ceil(length(p) / {limit}.0) AS BIGINT))), lambda k: substring(p, k * {limit} + 1, {limit})))), "
              "lambda p: length(p) > 0)")
    packed = (f"string_split(list_reduce(list_prepend('', {pieces}), lambda acc, x: CASE WHEN "
              f"length(string_split(acc, chr(2))[-1]) + length(x) <= {limit} THEN acc || x ELSE acc || chr(2) || x END), chr(2))")
    return (f"list_filter(list_transform(list_zip(list_prepend('', list_transform({packed}, lambda p: right(p, {overlap}))[:-2]), "
            f"{packed}), lambda z: regexp_replace(z[1] || z[2], {_sql_str(_EDGE_SPACE)}, '', 'g')), lambda x: length(x) > 0)")


# --- classification ---------------------------------------------------------

# Keyword rules of the reference's check (any match → first class).
BIKE_KEYWORDS = ("bike", "bicycle", "mondracer", "downhill", "xtreme", "road")
CLASS_LABELS = ("BIKE", "SNOW")
CLASSIFY_PREFIX_CHARS = 500


def classify_input(name: str | Column, text: str | Column) -> Column:
    """``name || '. ' || LEFT(text, 500)`` — NULL if either side is NULL."""
    n = F.col(name) if isinstance(name, str) else name
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(n, F.lit(". "), F.left(t, F.lit(CLASSIFY_PREFIX_CHARS)))


def keyword_class(col: str | Column, keywords=BIKE_KEYWORDS, labels=CLASS_LABELS) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    hit = None
    for k in keywords:
        h = c.ilike(f"%{k}%")
        hit = h if hit is None else (hit | h)
    return F.when(hit, F.lit(labels[0])).otherwise(F.lit(labels[1]))


def sql_keyword_class(expr: str, keywords=BIKE_KEYWORDS, labels=CLASS_LABELS) -> str:
    cond = " OR ".join(f"{expr} ILIKE '%{k}%'" for k in keywords)
    return f"CASE WHEN {cond} THEN '{labels[0]}' ELSE '{labels[1]}' END"


# --- prompts ----------------------------------------------------------------

# Fixed value: the reference's image-description prompt template.
DESCRIBE_PROMPT = (
    "Provide a detailed description of this product image {0}. Focus on the product shown, "
    "its visible features, design characteristics, colors, components, and any relevant details "
    "useful for a customer considering this product."
)


def prompt(template: str, *args: str | Column) -> Column:
    """Numbered template: ``{0}``, ``{1}``… replaced by the argument columns."""
    out = F.lit(template)
    for i, a in enumerate(args):
        col = F.col(a) if isinstance(a, str) else a
        out = F.replace(out, F.lit("{" + str(i) + "}"), col)
    return out
