"""Text and formula normalisation as Column expressions, and block segmentation of Markdown corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docintake.functions.text import ARGUMENT, CLOSE, LEVELS, OPEN, braces_balanced, collapse_blank_lines, entity_decode, mark_braces, once, replace_command, strip, unmark_braces

# Symbols and the commands they stand for.
SYMBOLS = {
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "ϵ": r"\varepsilon", "ζ": r"\zeta", "η": r"\eta", "θ": r"\theta", "ϑ": r"\vartheta", "ι": r"\iota",
    "κ": r"\kappa", "λ": r"\lambda", "μ": r"\mu", "ν": r"\nu", "ξ": r"\xi", "π": r"\pi", "ρ": r"\rho", "σ": r"\sigma", "τ": r"\tau", "φ": r"\phi", "ϕ": r"\varphi", "χ": r"\chi", "ψ": r"\psi",
    "ω": r"\omega", "Δ": r"\Delta", "Σ": r"\Sigma", "Π": r"\Pi", "Λ": r"\Lambda", "ℓ": r"\ell", "≤": r"\le ", "≥": r"\ge ", "×": r"\times ",
}
# Commands of presentation, of papers, of citations and of accents, names that aren't written out, Greek names.
VISIBLE = ("textnormal", "operatorname", "textbf", "textit", "textsc", "textrm", "emph", "mathrm", "mathbf", "mathtt")
PAPER_COMMANDS, CITATIONS = ("xspace", "NB", "DX", "lpk", "wx", "qz"), ("cite", "citep", "ref", "label", "url", "href")
ACCENTS = "overline|underline|hat|widehat|tilde|widetilde|bar|vec|dot|ddot|check|breve|acute|grave"
UNSAFE_NAMES = ("R", "N", "Z", "C", "E", "P", "Q", "KL", "Var", "Cov", "argmax", "argmin", "max", "min", "sin", "cos", "tan", "log", "exp", "sqrt", "frac")
GREEK = "alpha|beta|gamma|delta|epsilon|varepsilon|zeta|eta|theta|vartheta|iota|kappa|lambda|Lambda|mu|nu|xi|pi|rho|sigma|tau|upsilon|phi|varphi|chi|psi|omega"
# Commands whose argument is text.
TEXT_COMMANDS = ("text", "textnormal", "textsc", "textbf", "textit", "emph", "mathtt", "operatorname")
# Repairs of commands from papers and of split or fused commands: (pattern, replacement), in order.
REPAIRS = (
    (r"\\le\s+ft\b", r"\\left"), (r"\\ri\s+ght\b", r"\\right"), (r"(?<=\^)\\to\s+p\b", r"\\top"), (r"\\in\s+fty\b", r"\\infty"), (r"\\ap\s+prox\b", r"\\approx"),
    (r"\\ge\s+q\b", r"\\geq"), (r"\\le\s+q\b", r"\\leq"),
    (rf"\\(?:label|ref|eqref|tag){ARGUMENT}", ""), (r"\\nonumber\b", ""),
    (rf"\\(?:mathsfit|tens|etens|matrix|vector)(?![A-Za-z]){ARGUMENT}", r"\\mathbf{${a}}"), (rf"\\tr(?![A-Za-z]){ARGUMENT}", r"{${a}}^\\top"),
    (rf"\\rv({GREEK})(?![A-Za-z])", r"\\mathbf{\\$1}"), (r"\\rv([A-Za-z]+)(?![A-Za-z])", r"\\mathbf{$1}"), (r"\\rm([A-Z])(?![A-Za-z])", r"\\mathbf{$1}"),
    (r"\\er[vm]([A-Za-z])(?![A-Za-z])", r"\\mathrm{$1}"), (r"\\e?t(Lambda)(?![A-Za-z])", r"\\mathbf{\\$1}"), (r"\\e?t([A-Z][A-Za-z]*)(?![A-Za-z])", r"\\mathbf{$1}"),
    (rf"\\({ACCENTS})\s+([A-Za-z])", r"\\$1{$2}"), (rf"\\({ACCENTS})([A-Z])", r"\\$1{$2}"),
)
REPAIRS_AFTER = (
    (r"\\bm([A-Za-z])(?=[^A-Za-z]|$)", r"\\mathbf{$1}"),
    (r"\\(?:m|v)([A-Z])(?=\b|_)", r"\\mathbf{$1}"), (r"\\g([A-Z])(?=\b|_)", r"\\mathcal{$1}"), (r"\\mathcal([A-Za-z])\b", r"\\mathcal{$1}"), (r"\\(?:Ls|mathcalL)(?=\b|_)", r"\\mathcal{L}"),
    (r"\\R\b", r"\\mathbb{R}"), (r"\\rm\s+([A-Za-z][A-Za-z0-9]*)", r"\\mathrm{$1}"), (r"\\rm\b", r"\\mathrm"), (r"\\sg\b", r"\\mathrm{sg}"), (r"\\softmax\b", r"\\mathrm{softmax}"),
    (r"(?<!\\)(?<![A-Za-z])(softmax|stopgrad)(?=\s*(?:\\left|\())", r"\\mathrm{$1}"), (r"\\(KL|TopK)\b", r"\\mathrm{$1}"),
    (r"\\(qquad|quad)(?:\s+)?([A-Za-z])", r"\\$1{}$2"), (r"\\(le|leq|ge|geq|approx|to|in|notin)([A-Z\\])", r"\\$1 $2"),
    (r"(\d+)\\mathrm\{e\}\{(-?\d+)\}", r"$1\\times10^{$2}"), (r"(\d+)\\mathrm\{e\}\s*([+-]\d+)", r"$1\\times10^{$2}"),
)

# Commands that are known where one backslash too many stands before them.
COMMANDS = (
    "alpha", "approx", "bar", "begin", "beta", "bmatrix", "cdot", "chi", "circ", "cos", "cup", "delta", "dot", "doteq", "dots", "ell", "end", "epsilon", "eta", "frac", "gamma", "ge", "geq", "hat", "in", "infty", "int", "kappa", "lambda",
    "Lambda", "le", "leq", "left", "log", "mathbb", "mathbf", "mathcal", "mathrm", "mathsf", "mathit", "max", "mu", "nabla", "neg", "neq", "notin", "nu", "omega", "operatorname", "overline", "partial", "phi", "pi", "pm", "psi", "qquad", "quad",
    "rho", "right", "rightarrow", "rm", "sigma", "sin", "sqrt", "star", "substack", "sum", "tau", "text", "textbf", "textit", "textnormal", "theta", "times", "to", "top", "triangleq", "varphi", "vartheta", "vec", "xi", "zeta",
)
# Greek names and functions that make a word with an underscore or brackets math, not code.
MATH_WORDS = ("alpha", "beta", "chi", "delta", "eta", "gamma", "kappa", "lambda", "mu", "nu", "omega", "phi", "psi", "rho", "sigma", "tau", "theta")
MATH_FUNCTIONS = ("argmax", "argmin", "cos", "det", "exp", "f", "g", "h", "log", "max", "mean", "min", "p", "q", "relu", "sigmoid", "sin", "softmax", "sqrt", "sum", "tanh", "var")

# A number with its errors above and below, as raw TeX.
_NUMBER = r"[+-]?(?:\d+(?:\.\d+)?|\.\d+)"
RAW_UNCERTAINTY = rf"(?<![\w.]){_NUMBER}\s*(?:\^\s*\{{\s*{_NUMBER}\s*\}}\s*_\s*\{{\s*{_NUMBER}\s*\}}|_\s*\{{\s*{_NUMBER}\s*\}}\s*\^\s*\{{\s*{_NUMBER}\s*\}})(?![\w.])"

SPAN = r"(?s)<latex>.*?</latex>|<code>.*?</code>"


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, kind (prose, formula, code), text: the parts of each document in order."""
    marked = F.regexp_replace(F.col(text), f"({SPAN})", "\x1e$1\x1e")
    rows = docs.select(key, F.posexplode(F.split(marked, "\x1e")).alias("pos", "text"))
    return rows.withColumn("kind", F.when(F.col("text").rlike(r"(?s)^<latex>.*</latex>$"), "formula").when(F.col("text").rlike(r"(?s)^<code>.*</code>$"), "code").otherwise("prose"))


def map_parts(text: Column, change: Callable[[Column], Column], formulas: bool = False, protected: str = SPAN) -> Column:
    """``text`` with ``change`` applied to what lies outside of protected spans, or to the spans if ``formulas``."""
    parts = F.split(F.regexp_replace(text, f"({protected})", "\x1e$1\x1e"), "\x1e")
    own = lambda x, i: i % 2 == (1 if formulas else 0)
    return F.array_join(F.transform(parts, lambda x, i: F.when(own(x, i), change(x)).otherwise(x)), "")


def symbols_to_commands(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SYMBOLS.items() for x in kv))
    has = c.rlike("[" + "".join(SYMBOLS) + "]")
    return F.when(has, F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")).otherwise(c)


def decode_formula(c: Column) -> Column:
    """Entities decoded and layout tags as spaces."""
    return F.regexp_replace(F.regexp_replace(entity_decode(c), r"(?i)<\s*br\s*/?\s*>", " "), r"(?i)<\s*/?\s*(?:p|div)\b[^>]*>", " ")


def plain_content(c: Column) -> Column:
    """A command's content (marked) as text: trimmed, commands with a simple argument replaced by it, others gone."""
    inner = rf"\\[A-Za-z]+\s*([{LEVELS[0]}]){OPEN}([^{OPEN}{CLOSE}]*){CLOSE}\1"
    return F.regexp_replace(F.regexp_replace(strip(c), inner, "$2"), r"\\[A-Za-z]+", "")


def flatten_substack(marked: Column) -> Column:
    """The lines of a stack under a sum, separated by commas."""
    return replace_command(marked, "substack", lambda x: F.trim(F.regexp_replace(F.replace(x, F.lit("\\\\"), F.lit(", ")), r"(?U)\s+", " ")))


def text_commands(marked: Column) -> Column:
    """Text commands of formulas as upright letters."""
    upright = lambda x: F.concat(F.lit("\\mathrm{"), x, F.lit("}"))
    marked = F.regexp_replace(replace_command(marked, "mbox", plain_content), r"\\xspace\b", "")
    for name in TEXT_COMMANDS:
        marked = replace_command(marked, name, lambda x: upright(plain_content(x)))
    return replace_command(marked, "mathrm", lambda x: upright(F.regexp_replace(F.regexp_replace(strip(x), r"\\\s+", " "), r"(?U)\s+", " ")))


def bold_symbols(marked: Column) -> Column:
    """Bold symbols: letters and what hangs on them; other contents stand alone."""
    letter = r"(?s)^[A-Za-z](?:[_^].*)?$"
    for name in ("boldsymbol", "bm"):
        marked = replace_command(marked, name, lambda x: F.when(strip(x).rlike(letter), F.concat(F.lit("\\mathbf{"), strip(x), F.lit("}"))).otherwise(strip(x)))
    return marked


def break_cases(c: Column) -> Column:
    """Two cases that lost the break between their rows get it back: value, condition, value, condition."""
    row = r"(?s)\\begin\{cases\}\s*((?:(?!\\\\|,\s*&|\\end\{cases\}).)+?)\s*,\s*&\s*((?:(?!\\\\|,\s*&|\\end\{cases\}).)+?)\s{2,}(\\[A-Za-z](?:(?!\\\\|,\s*&|\\end\{cases\}).)*?)\s*,\s*&\s*((?:(?!\\\\|\\end\{cases\}).)+?)\s*\\end\{cases\}"
    return F.regexp_replace(c, row, r"\\begin{cases}$1 & $2 \\\\ $3 & $4\\end{cases}")


def repair_formula(c: Column) -> Column:
    """Repairs of split, fused and private commands. Braces are marked while arguments are told, whatever their depth."""
    c = flatten_substack(mark_braces(c))
    for pattern, new in REPAIRS:
        c = F.regexp_replace(c, pattern, new)
    c = unmark_braces(bold_symbols(text_commands(c)))
    for pattern, new in REPAIRS_AFTER:
        c = F.regexp_replace(c, pattern, new)
    return break_cases(c)


def recover_overescaped(c: Column) -> Column:
    r"""Formulas with one backslash for two before known commands and before brackets; ``\\\\j`` may be a row's end."""
    c = F.regexp_replace(c, rf"\\\\({'|'.join(COMMANDS)})(?![A-Za-z])", r"\\$1")
    return F.regexp_replace(c, r"\\\\(?=[{}\[\]()])", r"\\")


def code_like(c: Column) -> Column:
    """Is a span a program's identifier: a name of several words joined by underscores, or a call with an argument that
    has one; not where its first word, or all of it, is a name of mathematics."""

    def told(t: Column) -> Column:
        shape = r"^([A-Za-z_][A-Za-z0-9_.]*)(?:\(([A-Za-z0-9_.,'\"\s-]*)\))?$"
        name, call = F.regexp_extract(t, shape, 1), F.regexp_extract(t, shape, 2)
        words = F.split(name, "_")
        of_math = F.lower(F.get(words, 0)).isin(*MATH_WORDS) | F.lower(name).isin(*MATH_FUNCTIONS)
        snake = (F.size(words) >= 2) & ~F.exists(words, lambda w: F.length(w) < 2)
        return (name != "") & ~t.rlike(r"[\\\n{}=+*/^<>≤≥]") & ~of_math & (snake | (call.contains("_") & (F.length(name) >= 3)))

    return once(strip(entity_decode(c)), told)


def backticks_to_tags(c: Column) -> Column:
    """Back-ticked math that can be published as formulas; code stays code, and code in formula tags goes back."""
    shapes = (r"\\[A-Za-z]+|[_^]", r"[α-ωΑ-Ωϑϕϵℓ≤≥×]", r"^[A-Za-z]$", r"^\(?[A-Za-z](?:\s*,\s*[A-Za-z])+\)?$", r"^[A-Za-z0-9.{}()\[\],\s]+(?:[=<>+*/-][A-Za-z0-9.{}()\[\],\s]*)+$", r"^\[[0-9.,\s]+\]$")
    math = lambda x: x.rlike("|".join(f"(?:{p})" for p in shapes)) & ~code_like(x)
    tick = lambda x: F.trim(F.regexp_extract(x, "^`([^`\n]{1,240})`$", 1))
    to_tag = lambda x: once(normalise_formula(tick(x)), lambda b: F.when(math(tick(x)) & valid_formula(b), F.concat(F.lit("<latex>"), b, F.lit("</latex>"))).otherwise(x))
    c = map_parts(c, to_tag, formulas=True, protected="`[^`\n]{1,240}`")
    body = lambda x: F.regexp_extract(x, r"(?s)^<latex>(.*)</latex>$", 1)
    return map_parts(c, lambda x: F.when(code_like(body(x)), F.concat(F.lit("`"), F.trim(body(x)), F.lit("`"))).otherwise(x), formulas=True, protected=r"(?s)<latex>.*?</latex>")


def normalise_formula(c: Column) -> Column:
    return repair_formula(F.replace(symbols_to_commands(decode_formula(c)), F.lit(r"\_"), F.lit("_")))


def strip_visible_macros(c: Column) -> Column:
    """Prose without presentation commands."""
    c = mark_braces(c)
    for name in sorted(VISIBLE, key=len, reverse=True):
        c = replace_command(c, name, plain_content)
    c = unmark_braces(c)
    c = F.regexp_replace(c, rf"\\(?:{'|'.join(VISIBLE)})(?=[A-Za-z])", "")
    c = F.regexp_replace(c, rf"\\(?:{'|'.join(PAPER_COMMANDS)})(?![A-Za-z])", "")
    return F.regexp_replace(c, rf"\\(?:{'|'.join(CITATIONS)})\s*\{{[^{{}}]*\}}", "")


def prose_macros(macros: DataFrame) -> DataFrame:
    """Macros (paper_id, name, value) that can safely be written out in prose."""
    v = F.trim("value")
    return macros.filter(~F.col("name").isin(*UNSAFE_NAMES) & (F.length(v) >= 2) & ~v.rlike(r"[\\{}_^]"))


def _expanded(c: Column, macros: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """``c`` with each macro of an array of (name, value) written out, long names first."""
    longest = F.array_sort(macros, lambda x, y: F.when(F.length(x["name"]) != F.length(y["name"]), F.length(y["name"]) - F.length(x["name"])).when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0))
    literal = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    name = lambda m: F.concat(F.lit(r"\\\Q"), m["name"], F.lit(r"\E"), F.lit(pattern))
    return F.aggregate(longest, c, lambda acc, m: F.regexp_replace(acc, name(m), new(literal(m["value"]))))


def expand_prose_macros(c: Column, macros: Column) -> Column:
    """Prose with a paper's macros (array of name, value; see ``prose_macros``) written out; formulas stay. Space
    behind a macro becomes one space."""

    def both(x: Column) -> Column:
        x = _expanded(x, macros, r"(?![A-Za-z])\s+", lambda v: F.concat(v, F.lit(" ")))
        return _expanded(x, macros, r"(?![A-Za-z])", lambda v: v)

    return map_parts(c, both, protected=r"(?s)<latex>.*?</latex>")


def expand_formula_macros(c: Column, plain: Column, with_argument: Column) -> Column:
    """A formula with a paper's macros without and with one argument (``#1``) written out, macros in macros once."""
    for _ in range(2):
        c = _expanded(c, plain, r"(?![A-Za-z])", lambda v: v)
        c = unmark_braces(_expanded(mark_braces(c), with_argument, rf"(?![A-Za-z]){ARGUMENT}", lambda v: F.replace(v, F.lit("#1"), F.lit("${a}"))))
    return c


def table_row(line: Column) -> Column:
    t = F.trim(line)
    return t.startswith("|") & t.endswith("|") & (F.length(t) > 1) | (F.regexp_count(t, F.lit(r"\|")) >= 2)


def table_uncertainty(c: Column) -> Column:
    """Values with raw errors in table rows become formulas."""
    wrap = lambda x: F.regexp_replace(x, f"(?U)({RAW_UNCERTAINTY})", "<latex>$1</latex>")
    rule = r"^\s*\|?[\s:|\-]+\|?\s*$"
    lines = F.transform(F.split(c, "\n"), lambda x: F.when(table_row(x) & ~x.rlike(rule), map_parts(x, wrap, protected=r"(?si)<latex>.*?</latex>|`[^`\n]*`")).otherwise(x))
    return F.array_join(lines, "\n")


def math_to_tags(c: Column) -> Column:
    r"""$$, \[ \], \( \) and $ math as formula tags."""
    c = F.regexp_replace(c, r"(?s)`\s*(<latex>.*?</latex>)\s*`", "$1")
    for pattern, new in ((r"(?s)\$\$\s*(.*?)\s*\$\$", "\n<latex>$1</latex>\n"), (r"(?s)\\\[\s*(.*?)\s*\\\]", "\n<latex>$1</latex>\n"), (r"\\\((.{1,240}?)\\\)", "<latex>$1</latex>"), (r"(?<!\$)\$([^\n$]{1,240})\$(?!\$)", "<latex>$1</latex>")):
        c = F.regexp_replace(c, pattern, new)
    return F.regexp_replace(c, r"(?m)^#+\s*(<latex>.*?</latex>)\s*$", "$1")


def flatten_tags(c: Column) -> Column:
    for _ in range(3):
        c = F.regexp_replace(F.regexp_replace(c, r"(?i)<latex>\s*<latex>", "<latex>"), r"(?i)</latex>\s*</latex>", "</latex>")
    return c


def breaks_to_lines(c: Column) -> Column:
    return map_parts(c, lambda x: F.regexp_replace(x, r"(?i)<br\s*/?>", "\n"))


def valid_formula(c: Column) -> Column:
    r"""Can a formula be published: not empty, braces and \left ... \right balanced, and no Chinese or replacement
    characters, definitions, environments that aren't supported, fused spacing commands, \rm, or prose."""
    count = lambda x: F.regexp_count(c, F.lit(x))
    wrong = (
        r"[\x{4e00}-\x{9fff}\x{fffd}]", r"\\(?:def|newcommand|renewcommand|usepackage|RequirePackage)\b", r"\\(?:begin|end)\s*\{(?!aligned|align|array|matrix|pmatrix|bmatrix|cases)[^{}]+\}",
        r"\\(?:qquad|quad)[A-Za-z]", r"\\rm\b", r"\\[A-Za-z]+(?:\s+[A-Za-z]{3,}){3,}",
    )
    return (strip(c) != "") & braces_balanced(c) & (count(r"\\left(?![A-Za-z])") == count(r"\\right(?![A-Za-z])")) & ~c.rlike("|".join(f"(?:{p})" for p in wrong))


FORMULA = r"(?is)<latex\b[^>]*>.*?</latex\s*>"
_OPEN, _CLOSE = r"(?i)^<latex\b[^>]*>", r"(?i)</latex\s*>$"


def compile_markup(c: Column) -> Column:
    """Boundaries between prose and formulas put in order: escaped paragraph wrappers read, paragraph tags removed
    from prose, breaks in formulas as spaces, nested formula tags removed, and one backslash for two before known
    commands."""
    lower, upper = r"(?:&lt;|&#0*60;|&#x0*3c;)", r"(?:&gt;|&#0*62;|&#x0*3e;)"
    escaped = rf"(?is){lower}\s*/?\s*(?:p|div|br)\b[^<>]*{upper}"
    inner = lambda x: F.regexp_extract(x, rf"(?is)^{lower}\s*(.*){upper}$", 1)
    c = map_parts(c, lambda x: F.when(inner(x).rlike(f"(?i){upper}|&amp;"), x).otherwise(F.concat(F.lit("<"), inner(x), F.lit(">"))), formulas=True, protected=escaped)

    def body(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, _OPEN, ""), _CLOSE, "")
        x = F.regexp_replace(F.regexp_replace(x, r"(?i)<\s*br\b[^>]*>", " "), r"(?i)<\s*/?\s*(?:p|div|br)\b[^>]*>", "")
        return F.concat(F.lit("<latex>"), recover_overescaped(F.regexp_replace(x, r"(?i)<\s*/?\s*latex\b[^>]*>", "")), F.lit("</latex>"))

    parts = F.split(F.regexp_replace(c, f"({FORMULA})", "\x1e$1\x1e"), "\x1e")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, body(x)).otherwise(F.regexp_replace(x, r"(?i)<\s*/?\s*(?:p|div)\b[^>]*>", ""))), "")


def markup_diagnostics(c: Column) -> Column:
    """The codes of what is wrong with a document's formulas and can't be put in order, in order of appearance."""
    bodies = F.regexp_extract_all(c, F.lit(f"({FORMULA})"), F.lit(1))

    def codes(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, _OPEN, ""), _CLOSE, "")
        tags = F.filter(F.regexp_extract_all(x, F.lit(r"<\s*/?\s*[A-Za-z][^<>]*>"), F.lit(0)), lambda t: ~t.rlike(r"(?i)^<\s*/?\s*(?:p|div|br)\b"))
        return F.array_compact(F.concat(F.transform(tags, lambda t: F.lit("unknown-html-in-formula")), F.array(F.when(~braces_balanced(F.regexp_replace(x, r"<[^>]*>", "")), F.lit("unbalanced-braces")))))

    return F.flatten(F.transform(bodies, codes))


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, block, kind, text: blocks of Markdown. A blank line ends a block; a heading is a block of its own; a
    list or table ends where lines of another kind follow; a formula that spans lines stays together. Lines are
    numbered within their document and blocks are running sums over them."""
    w = Window.partitionBy(key).orderBy("at")
    line = F.trim("line")
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    opens = F.regexp_count(F.lower("line"), F.lit(r"<latex\b[^>]*>")) - F.regexp_count(F.lower("line"), F.lit(r"</latex\s*>"))
    rows = rows.withColumn("depth", F.coalesce(F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kind = (
        F.when(F.col("depth") > 0, "formula").when(line == "", "blank").when(line.rlike(r"^#{1,6}\s+\S"), "heading").when(table_row(F.col("line")), "table")
        .when(line.rlike(r"^[-*+]\s+"), "unordered-list").when(line.rlike(r"^\d+[.)]\s+"), "ordered-list").otherwise("paragraph")
    )
    rows = rows.withColumn("kind", kind)
    before = F.lag("kind").over(w)
    new = (F.col("kind") != "formula") & (before.isNull() | (F.col("kind") == "heading") | before.isin("heading", "blank") | ((before != "formula") & (before != F.col("kind"))))
    rows = rows.withColumn("block", F.sum((new | (F.col("kind") == "blank")).cast("int")).over(w)).filter("kind <> 'blank'")
    out = rows.groupBy(key, "block").agg(F.min_by("kind", "at").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.rtrim("line").alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return out.withColumn("block", F.row_number().over(Window.partitionBy(key).orderBy("block")) - 1)


def drop_false_warnings(docs: DataFrame, key: str = "doc_id", text: str = "text", word: str = "材料不足") -> DataFrame:
    """Documents without the paragraphs that claim a lack of material: from a line with the word to the next
    blank line, heading, summary or table row."""
    w = Window.partitionBy(key).orderBy("at")
    line = F.trim("line")
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    reset = (line == "") | line.startswith("#") | line.startswith("**TL;DR**") | line.startswith("|")
    mark = F.when(F.col("line").contains(word), F.lit(1)).when(reset, F.lit(0))
    rows = rows.withColumn("mark", mark).withColumn("skip", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit(0)))
    ended = (F.lag("skip").over(w) == 1) & (line == "")  # the blank line that ends a dropped paragraph goes too
    rows = rows.withColumn("drop", (F.col("skip") == 1) | F.coalesce(ended, F.lit(False))).filter("not drop")
    kept = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias(text))
    return docs.select(key).join(kept, key, "left").withColumn(text, F.coalesce(text, F.lit("")))


#: The steps of ``polish``, in order; each is a Column expression, and users can put in their own.
POLISH: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("compile", compile_markup),
    ("flatten", flatten_tags),
    ("back-ticks", backticks_to_tags),
    ("tags", math_to_tags),
    ("tables", table_uncertainty),
    ("formulas", lambda c: map_parts(c, normalise_formula, formulas=True, protected=r"(?s)<latex>.*?</latex>")),
    ("breaks", breaks_to_lines),
    ("macros", lambda c: map_parts(c, strip_visible_macros)),
    ("compile again", compile_markup),
    ("flatten again", flatten_tags),
    ("blank lines", lambda c: F.concat(F.trim(collapse_blank_lines(c), F.lit("\n ")), F.lit("\n"))),
)


def polish(docs: DataFrame, text: str = "text", steps=POLISH, macros: str | None = None) -> DataFrame:
    """``docs`` with all normalisation steps applied to ``text``, each in a projection of its own. ``macros`` names a
    column struct<prose, plain, argument> of arrays of (name, value), the paper's macros."""
    for name, step in steps:
        docs = docs.withColumn(text, step(F.col(text)))
        if macros and name == "tables":
            body = lambda x: F.concat(F.lit("<latex>"), expand_formula_macros(F.regexp_extract(x, r"(?s)^<latex>(.*)</latex>$", 1), F.col(f"{macros}.plain"), F.col(f"{macros}.argument")), F.lit("</latex>"))
            docs = docs.withColumn(text, map_parts(F.col(text), body, formulas=True, protected=r"(?s)<latex>.*?</latex>"))
        if macros and name == "breaks":
            docs = docs.withColumn(text, expand_prose_macros(F.col(text), F.col(f"{macros}.prose")))
    return docs


def compiled_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, kind (text, formula), value, start, end: what ``compile_markup`` makes of each document, part by part,
    and where in the document (from 0, end excluded) each part was made from. Prose of which nothing is left gives no
    token; the values, with formula tags around formulas, joined are the compiled document."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"({FORMULA})", "\x1e$1\x1e"), "\x1e")
    rows = docs.select(key, F.posexplode(parts).alias("pos", "source"))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("source")).over(w), F.lit(0)).cast("bigint")).withColumn("made", compile_markup(F.col("source")))
    formula = F.col("pos") % 2 == 1
    value = F.when(formula, F.regexp_extract("made", r"(?s)^<latex>(.*)</latex>$", 1)).otherwise(F.col("made"))
    rows = rows.select(key, "pos", F.when(formula, "formula").otherwise("text").alias("kind"), value.alias("value"), "start", (F.col("start") + F.length("source")).alias("end"))
    return rows.filter("kind = 'formula' or value <> ''")


def markup_problems(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, code, severity, start, end, said of what is wrong with a document's formulas: unknown tags at their own
    place, unbalanced braces at the formula's content, and one note where paragraph tags around formulas were removed."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = docs.select(key, F.coalesce(text, F.lit("")).alias("text"))
    rows = whole.select(key, F.posexplode(F.split(F.regexp_replace("text", f"({FORMULA})", "\x1e$1\x1e"), "\x1e")).alias("pos", "source"))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("source")).over(w), F.lit(0)).cast("bigint")).filter("pos % 2 = 1")
    body = F.regexp_replace(F.regexp_replace("source", _OPEN, ""), _CLOSE, "")
    rows = rows.select(key, body.alias("body"), (F.col("at") + F.length(F.regexp_extract("source", _OPEN, 0))).alias("at"))
    tag = r"<\s*/?\s*[A-Za-z][^<>]*>"
    rows = rows.withColumns({"tags": F.regexp_extract_all("body", F.lit(f"({tag})"), F.lit(1)), "gaps": F.split("body", tag)})
    reach = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x))
    one = lambda code, severity, start, end, said: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), start.alias("start"), end.alias("end"), said.alias("said"))

    def unknown(t: Column, i: Column) -> Column:
        start = F.col("at") + reach("gaps", i + 1) + reach("tags", i)
        return F.when(~t.rlike(r"(?i)^<\s*/?\s*(?:p|div|br)\b"), one("unknown-html-in-formula", "high", start, start + F.length(t), t))

    clean = F.regexp_replace("body", r"(?i)<\s*/?\s*(?:p|div|br|latex)\b[^>]*>", "")
    braces = F.when(~braces_balanced(recover_overescaped(clean)), one("unbalanced-braces", "high", F.col("at"), F.col("at") + F.length("body"), F.lit("")))
    found = rows.select(key, F.explode(F.array_compact(F.concat(F.transform("tags", unknown), F.array(braces)))).alias("p"))
    wrapped = F.regexp_replace("text", r"(?is)(?:&lt;|&#0*60;|&#x0*3c;)\s*(/?\s*p\b[^<>]*?)(?:&gt;|&#0*62;|&#x0*3e;)", "<$1>").rlike(r"(?is)<\s*p\b[^>]*>\s*<latex>.*?</latex>\s*</\s*p\s*>")
    note = whole.filter(wrapped).select(key, one("recovered-formula-wrapper", "info", F.lit(0).cast("bigint"), F.length("text").cast("bigint"), F.lit("")).alias("p"))
    return found.unionByName(note).select(key, "p.*")


def formula_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, kind (text, formula), start, value: the tokens of each document with their offsets."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.select(key, F.posexplode(F.split(F.regexp_replace(text, r"(?s)(<latex>.*?</latex>)", "\x1e$1\x1e"), "\x1e")).alias("pos", "value")).filter("value <> ''")
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("value")).over(w), F.lit(0)).cast("bigint"))
    return rows.select(key, "pos", F.when(F.col("value").rlike(r"(?s)^<latex>"), "formula").otherwise("text").alias("kind"), "start", "value")


def formula_diagnostics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, code of formulas with unbalanced braces, unknown tags, or no end."""
    tokens = formula_tokens(docs, key, text)
    body = F.regexp_replace("value", r"(?s)^<latex>|</latex>$", "")
    codes = F.when(F.col("kind") == "formula", F.array_compact(F.array(F.when(~braces_balanced(body), "unbalanced-braces"), F.when(F.regexp_replace(body, r"(?i)<\s*/?\s*(?:p|div|br)\b[^>]*>", "").rlike(r"<\s*/?\s*[A-Za-z][^<>]*>"), "unknown-html-in-formula")))).otherwise(F.array_compact(F.array(F.when(F.col("value").rlike("</?latex>"), "unclosed-formula"))))
    return tokens.select(key, "pos", F.explode(codes).alias("code"))
