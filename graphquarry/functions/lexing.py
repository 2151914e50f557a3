"""State machines over source text as folds of atoms, for what one pattern cannot decide.

A text is cut into atoms: quotes, brackets, comment marks, line ends, and the runs between them. ``aggregate``
folds them with a small state: the lexical mode, the open contexts, and whether an expression may start, which
tells a regular expression from a division. What stays is collected in chunks, so a long text is not copied for every atom.
The callers use the folds for texts only that their faster patterns cannot read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

CHUNK_ATOMS = 256
#: Characters at the end of a run that tell what it ends with; longer than any word that matters.
TAIL = 24

# A run ends with the line at the latest, so an atom has one line end at most, as its last character.
_RUN = r"[^\\\"'`{}()/\n*$" + "%s" + r"]|\*(?!/)|\$(?!\{)"
_MARKS = r"\\.|//|/\*|\*/|\$\{|[\"'`{}()/\n]"
TS_ATOM = _MARKS + "|(?:" + _RUN % "" + r")++\n?|."
TSX_ATOM = _MARKS + "|=>|[<>]|(?:" + _RUN % "<>=" + r"|=(?!>))++\n?|."
TS_MARKS = "\"'`{}()/<>\\"
#: Words after which an expression starts, so that a slash opens a regular expression.
TS_BEFORE_EXPRESSION = (
    "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "do", "else", "yield", "await",
    "default", "extends",
)
TS_BEFORE_CONDITION = ("if", "while", "for", "with")
RUST_ATOM = (
    r"""//|/\*|\*/|\bb?r#*+"#*+|"#*+|\\[\\"]|'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]*+\}|x[0-9a-fA-F]{2}|.))'"""
    r"""|\n|(?:(?!\bb?r#*+")\w++|[^\w/*"\\'\n]++)++|."""
)

# Modes: code, strings, template text, regular expressions and their classes, comments, and the parts of markup.
CODE, LINE, BLOCK, TEMPLATE, REGEX, CLASS = "c", "l", "b", "`", "/", "k"
TAG_OPENS, TAG, TAG_ENDS, MARKUP, CHILD_OPENS, DOUBLE, SINGLE = "<", "t", "e", "j", "o", "D", "S"
# Contexts: template expression, markup children, expression among children, expression of an attribute.
IN_TEMPLATE, IN_MARKUP, IN_CHILD, IN_ATTRIBUTE = "$", "J", "x", "a"
QUIET = IN_TEMPLATE + IN_MARKUP + IN_CHILD + IN_ATTRIBUTE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(text: Column, atom: Callable[[str], Column], first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What a state machine keeps of ``text``. ``step(state, atom)`` gives the next state, with what to keep as its field ``say``.

    ``atom`` makes a pattern of a form that has ``{}`` for the atom's own pattern. ``aggregate`` copies its state at every
    step, so atoms are folded in chunks that hold their own text only, and an outer fold collects those.
    """
    start = lambda own: F.struct(own.alias("own"), F.lit("").alias("held"))

    def one(s: Column, a: Column) -> Column:
        return let(step(s["own"], a), lambda own: F.struct(own.alias("own"), F.concat(s["held"], own["say"]).alias("held")))

    def chunk(s: Column, part: Column) -> Column:
        folded = F.aggregate(F.regexp_extract_all(part, atom("(?s){}"), F.lit(0)), start(s["own"]), one)
        return let(folded, lambda f: F.struct(f["own"].alias("own"), F.concat(s["out"], F.array(f["held"])).alias("out")))

    zero = F.struct(first.alias("own"), F.array().cast("array<string>").alias("out"))
    chunks = F.regexp_extract_all(text, atom(f"(?s)(?:{{}}){{{{1,{CHUNK_ATOMS}}}}}+"), F.lit(0))
    return F.aggregate(chunks, zero, chunk, lambda s: F.array_join(s["out"], ""))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _move(mode: str, context: str = "", start: int | Column = -1, say: str | Column = "", condition: Column | None = None) -> Column:
    """One transition. ``context``: ``-`` leaves the innermost, another character enters it. ``start``: whether an expression
    may follow, -1 for as before. ``say``: ``atom`` keeps the atom, anything else is kept instead."""
    if isinstance(start, int) and isinstance(say, str) and condition is None:  # one call into the JVM, not a dozen
        return F.expr(
            f"named_struct('mode', {_quoted(mode)}, 'context', {_quoted(context)}, 'start', {start}, 'say', {_quoted(say)}, 'condition', false)"
        )
    start = F.lit(start) if isinstance(start, int) else start
    return F.struct(
        F.lit(mode).alias("mode"), F.lit(context).alias("context"), start.cast("int").alias("start"),
        (F.lit(say) if isinstance(say, str) else say).alias("say"), (F.lit(False) if condition is None else condition).alias("condition"),
    )


def _typescript_move(s: Column, a: Column, jsx: Column) -> Column:
    mode, starts = s["mode"], s["start"] == 1
    line_end = a.endswith("\n")
    last = F.regexp_extract(F.substring(a, -TAIL, TAIL), r"([\w$]++|\+\+|--|[^\s\w$])\s*+$", 1)

    def after_run(word: Column) -> Column:
        ends = word.isin("]", "++", "--") | word.rlike(r"^[\w$]")
        start = F.when(word == "", -1).when(word.isin(*TS_BEFORE_EXPRESSION), 1).when(ends, 0).otherwise(1)
        return _move(CODE, "", start, "atom", word.isin(*TS_BEFORE_CONDITION))

    run = F.instr(F.lit(TS_MARKS), F.substring(a, 1, 1)) == 0
    paren = F.when(s["condition"], _move(CODE, "i", 1, "atom")).otherwise(_move(CODE, "(", 1, "atom"))
    inner = F.substring(s["stack"], -1, 1)
    code = (
        F.when(a == "\n", _move(CODE, "", -1, "atom"))
        .when(run & ~a.isin("*/", "${"), let(last, after_run))
        .when(a == "{", _move(CODE, "{", 1, "atom"))
        .when(a == "}", F.when(inner == IN_TEMPLATE, _move(TEMPLATE, "-")).when(inner == IN_CHILD, _move(MARKUP, "-"))
              .when(inner == IN_ATTRIBUTE, _move(TAG, "-", 0)).otherwise(_move(CODE, "-", 1, "atom")))
        .when(a == "(", paren)
        .when(a == ")", _move(CODE, "-", F.when(inner == "i", 1).otherwise(0), "atom"))
        .when(a == "'", _move("'", "", 0, "atom")).when(a == '"', _move('"', "", 0, "atom"))
        .when(a == "`", _move(TEMPLATE, "", 0, "``"))
        .when(a == "//", _move(LINE, "", -1, " ")).when(a == "/*", _move(BLOCK, "", -1, " "))
        .when(a == "/", F.when(starts, _move(REGEX, "", 0, " ")).otherwise(_move(CODE, "", 1, "atom")))
        .when((a == "<") & jsx & starts, _move(TAG_OPENS))
        .when(a == "${", _move(CODE, "{", 1, "atom"))
        .otherwise(_move(CODE, "", 1, "atom"))
    )
    stay = lambda m: _move(m)
    breaks = F.when(line_end, "\n").otherwise("")
    named, generic = a.rlike(r"^[A-Za-z_$]"), a.rlike(r"^[\w$]+\s*(,|extends\b)") | (a == "const ")
    # a closed element stands in code or among the children of the element around it
    closed = F.when(inner == IN_MARKUP, stay(MARKUP)).otherwise(_move(CODE, "", 0))
    outer = F.substring(s["stack"], -2, 1)
    ended = F.when((F.length(s["stack"]) > 1) & (outer == IN_MARKUP), _move(MARKUP, "-")).otherwise(_move(CODE, "-", 0))
    quoted = F.when(a == mode, _move(CODE, "", 0, "atom")).when(line_end & ~a.startswith("\\"), _move(CODE, "", -1, "atom"))
    opens_class, leaves_class = a.rlike(r"\[[^\]]*+$"), a.rlike(r"\][^\[]*+$")
    return (
        F.when(mode == CODE, code)
        .when(mode == "'", quoted.otherwise(_move("'", "", -1, "atom")))
        .when(mode == '"', quoted.otherwise(_move('"', "", -1, "atom")))
        .when(mode == TEMPLATE, F.when(a == "`", _move(CODE, "", 0)).when(a == "${", _move(CODE, IN_TEMPLATE, 1)).when(line_end, _move(TEMPLATE, "", -1, "\n")).otherwise(stay(TEMPLATE)))
        .when(mode == LINE, F.when(line_end, _move(CODE, "", -1, "\n")).otherwise(stay(LINE)))
        .when(mode == BLOCK, F.when(a == "*/", stay(CODE)).when(line_end, _move(BLOCK, "", -1, "\n")).otherwise(stay(BLOCK)))
        .when(mode == REGEX, F.when((a == "/") | (a == "*/"), _move(CODE, "", 0)).when(a.isin("//", "/*"), _move(CODE, "", 1)).when(line_end, _move(CODE, "", -1, "\n"))
              .when(a.startswith("\\"), stay(REGEX)).when(opens_class, stay(CLASS)).otherwise(stay(REGEX)))
        .when(mode == CLASS, F.when(line_end, _move(CODE, "", -1, "\n")).when(a.startswith("\\"), stay(CLASS)).when(leaves_class, stay(REGEX)).otherwise(stay(CLASS)))
        .when(mode == TAG_OPENS, F.when(a == ">", _move(MARKUP, IN_MARKUP)).when(named & ~generic, _move(TAG, "", 0, breaks)).otherwise(_move(CODE, "", 1, "atom")))
        .when(mode == TAG, F.when(a == ">", F.when(starts, closed).otherwise(_move(MARKUP, IN_MARKUP))).when(a == "{", _move(CODE, IN_ATTRIBUTE, 1))
              .when(a == '"', stay(DOUBLE)).when(a == "'", stay(SINGLE)).when(a == "/", _move(TAG, "", 1))
              .when(line_end, _move(TAG, "", F.when(a == "\n", -1).otherwise(0), "\n")).otherwise(_move(TAG, "", 0)))
        .when(mode == DOUBLE, F.when(a == '"', _move(TAG, "", 0)).when(line_end, _move(DOUBLE, "", -1, "\n")).otherwise(stay(DOUBLE)))
        .when(mode == SINGLE, F.when(a == "'", _move(TAG, "", 0)).when(line_end, _move(SINGLE, "", -1, "\n")).otherwise(stay(SINGLE)))
        .when(mode == MARKUP, F.when(a == "{", _move(CODE, IN_CHILD, 1)).when(a == "${", _move(CODE, IN_CHILD, 1)).when(a == "<", stay(CHILD_OPENS))
              .when(line_end, _move(MARKUP, "", -1, "\n")).otherwise(stay(MARKUP)))
        .when(mode == CHILD_OPENS, F.when(a == "/", stay(TAG_ENDS)).when(a == ">", _move(MARKUP, IN_MARKUP)).when(named, _move(TAG, "", 0, breaks)).otherwise(_move(MARKUP, "", -1, breaks)))
        .otherwise(F.when(a == ">", ended).when(line_end, _move(TAG_ENDS, "", -1, "\n")).otherwise(stay(TAG_ENDS)))
    )


def typescript_code(text: Column, jsx: Column) -> Column:
    """TypeScript without comments, regular expressions, template contents and markup; other strings and line ends stay."""
    silent = lambda c: (c != "") & (F.instr(F.lit(QUIET), c) > 0)
    first = F.struct(
        F.lit(CODE).alias("mode"), F.lit("").alias("stack"), F.lit(1).alias("start"), F.lit(False).alias("condition"),
        F.lit(0).alias("quiet"), F.lit("").alias("say"),
    )

    def step(s: Column, a: Column) -> Column:
        def moved(m: Column) -> Column:
            leaves, same = m["context"] == "-", m["context"] == ""
            stack = (
                F.when(same, s["stack"]).when(leaves, F.substring(s["stack"], F.lit(1), F.length(s["stack"]) - 1))
                .otherwise(F.concat(s["stack"], m["context"]))
            )
            left = F.when(silent(F.substring(s["stack"], -1, 1)), s["quiet"] - 1).otherwise(s["quiet"])
            entered = F.when(silent(m["context"]), s["quiet"] + 1).otherwise(s["quiet"])
            said = F.when(m["say"] == "atom", a).otherwise(m["say"])
            return F.struct(
                m["mode"].alias("mode"), stack.alias("stack"), F.when(m["start"] < 0, s["start"]).otherwise(m["start"]).alias("start"),
                m["condition"].alias("condition"), F.when(same, s["quiet"]).when(leaves, left).otherwise(entered).alias("quiet"),
                F.when(s["quiet"] == 0, said).when(a.endswith("\n"), "\n").otherwise("").alias("say"),
            )

        return let(_typescript_move(s, a, jsx), moved)

    return _fold(text, lambda form: F.when(jsx, form.format(TSX_ATOM)).otherwise(form.format(TS_ATOM)), first, step)


def _rust_move(mode: str, depth: int | Column = 0, say: str | Column = "") -> Column:
    return F.struct(
        F.lit(mode).alias("mode"), (F.lit(depth) if isinstance(depth, int) else depth).alias("depth"),
        (F.lit(say) if isinstance(say, str) else say).alias("say"),
    )


def rust_code(text: Column) -> Column:
    """Rust without comments, nested to any depth, and without the contents of strings; line ends stay."""

    def step(s: Column, a: Column) -> Column:
        mode, depth, move = s["mode"], s["depth"], _rust_move
        quote, raw = F.contains(a, F.lit('"')), a.rlike('^b?r#*"')
        hashes = lambda pattern: F.length(F.regexp_extract(a, pattern, 1))
        breaks = F.when(a == "\n", "\n").otherwise("")
        code = (
            F.when(a == "//", move(LINE, 0, " ")).when(a == "/*", move(BLOCK, 1, " "))
            .when(raw, move("r", hashes('^b?r(#*)"'), '""')).when(a.startswith('"'), move("s", 0, '""'))
            .when(a.startswith("'") & (F.length(a) > 1), move(CODE, 0, "'_'")).otherwise(move(CODE, 0, a))
        )
        block = (
            F.when(a == "/*", move(BLOCK, depth + 1)).when((a == "*/") & (depth == 1), move(CODE))
            .when(a == "*/", move(BLOCK, depth - 1)).otherwise(move(BLOCK, depth, breaks))
        )
        closes = quote & ~a.startswith("\\") & ~a.startswith("'")
        return (
            F.when(mode == CODE, code)
            .when(mode == LINE, F.when(a == "\n", move(CODE, 0, "\n")).otherwise(move(LINE)))
            .when(mode == BLOCK, block)
            .when(mode == "s", F.when(closes, move(CODE)).otherwise(move("s", 0, breaks)))
            .otherwise(F.when(quote & (hashes('"(#*)$') >= depth), move(CODE)).otherwise(move("r", depth, breaks)))
        )

    return _fold(text, lambda form: F.lit(form.format(RUST_ATOM)), _rust_move(CODE), step)


def depth_of(text: Column, opens: str, closes: str) -> Column:
    """How deep brackets of one kind are nested in ``text``; closing ones without an opening one count as none."""
    only = F.regexp_replace(text, f"[^\\{opens}\\{closes}]+", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = F.when(c == opens, s["now"] + 1).otherwise(F.greatest(s["now"] - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    deep = F.aggregate(F.split(only, ""), zero, step, lambda s: s["most"])
    return F.when(F.contains(text, F.lit(opens)), deep).otherwise(0)


def flattened(text: Column, opens: str, closes: str, mark: str, level: str) -> Column:
    """``text`` with every outermost balanced bracket as ``mark``: innermost ones first, as often as they are nested.

    ``level`` is a character that stands for a bracket already closed and is part of no text.
    """
    inner = f"\\{opens}[^\\{opens}\\{closes}]*+\\{closes}"
    rounds = F.sequence(F.lit(1), depth_of(text, opens, closes))
    peeled = F.aggregate(rounds, text, lambda t, _: F.regexp_replace(t, inner, level))
    return F.when(F.contains(text, F.lit(closes)) & F.contains(text, F.lit(opens)), F.replace(peeled, F.lit(level), F.lit(mark))).otherwise(text)


def without_macros(text: Column) -> Column:
    """Rust code with each ``macro_rules!`` and its braces as ``;``, however deep; line ends stay, an unclosed body runs to the end."""
    head = r"\bmacro_rules!\s*+(?:r#)?\w++\s*+\{$"
    lines = lambda piece: F.regexp_replace(piece, r"[^\n]+", "")

    def step(s: Column, piece: Column) -> Column:
        inside = s["depth"] > 0
        begins = ~inside & piece.rlike(head)
        change = F.when(piece.endswith("{"), 1).when(piece.endswith("}"), -1).otherwise(0)
        depth = F.when(begins, 1).when(inside, s["depth"] + change).otherwise(0)
        before = F.concat(F.regexp_replace(piece, head, ";"), lines(F.regexp_extract(piece, head, 0)))
        return F.struct(depth.alias("depth"), F.when(begins, before).when(inside, lines(piece)).otherwise(piece).alias("say"))

    first = F.struct(F.lit(0).alias("depth"), F.lit("").alias("say"))
    folded = _fold(text, lambda form: F.lit(form.format(r"[^{}]*+[{}]|[^{}]++")), first, step)
    return F.when(F.contains(text, F.lit("macro_rules!")), folded).otherwise(text)
