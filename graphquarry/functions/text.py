"""Source-text columns: blanking of comments and literals, item marks, fact patterns.

Everything here is a narrow, per-row expression: no shuffle is needed to go from one file's
text to its facts. Comments and literals are found by one pattern that takes, at each place, whichever of
them begins first, so none can hide inside another. Repeated groups are possessive: the JVM's regex engine
runs those as loops, whatever the length of the text. Nesting and meanings that depend on what stands before
are no matter of patterns: texts that have them go through the folds of :mod:`graphquarry.functions.lexing`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from graphquarry.functions import lexing
from graphquarry.functions.lexing import let

MARK = "\u0001"       # starts an item, followed by its line number
MARK_END = "\u0002"   # ends the line number
GENERICS = "\u0003"   # stands for one balanced <...> list

# Built-in scalar type names of the Rust grammar, which never name an impl.
RUST_PRIMITIVES = (
    "u8", "i8", "u16", "i16", "u32", "i32", "u64", "i64", "u128", "i128",
    "isize", "usize", "f32", "f64", "bool", "str", "char",
)

TOKEN, TOKEN_END = "\u0004", "\u0005"  # around a comment or literal
LEVEL = "\u0006"      # stands for a bracket pair already closed

RUST_TOKEN = (
    r"(?s)//[^\n]*+|/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+\*/"
    r'|\bb?r(#*+)"(?:[^"]|"(?!\1))*+"\1|"(?:[^"\\]|\\.)*+"'
    r"|'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]*+\}|x[0-9a-fA-F]{2}|.))'"
)
TS_TOKEN = (
    r"(?s)//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"
    r"""|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`"""
)
TS_STRING = r"""(?s)"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'"""
RUST_ITEM = r"(?=\b(?:fn|struct|trait)\s+\w)"
RUST_SPLIT_ITEM = r"\b(fn|struct|trait)[ \t]*+(\n\s*+)((?:r#)?\w++)"
RUST_IMPL = r"(^|[{};\]])(\s*)(?=(?:unsafe\s+)?impl\b)"
RUST_USE = r"(?m)(?:^|[{};\]])[ \t]*((?:pub(?:\([^)]*\))?\s+)?use\s+[^;]+)(?=;)"
RUST_MOD = r"(?m)(?:^|[{};\]])[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+((?:r#)?\w+)\s*(?=;)"
TS_SPECIFIER = (
    r"""(?m)(?:^|;)[ \t]*(?:import\s*|(?:import|export)\b[^;"'=()]*?\bfrom\s*)"""
    r"""(["'])([^"'\n]+)\1"""
)


def _newlines(piece: Column) -> Column:
    return F.regexp_replace(piece, r"[^\n]+", "")


def _tokens_replaced(text: Column, token: str, replaced: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``token`` replaced by what ``replaced`` makes of it."""
    marked = F.regexp_replace(text, F.lit(token), F.lit(f"{TOKEN}$0{TOKEN_END}"))
    # marks come in pairs, so every second piece is a match
    pieces = F.transform(
        F.split(marked, f"[{TOKEN}{TOKEN_END}]"), lambda p, i: F.when(i.bitwiseAND(F.lit(1)) == 1, replaced(p)).otherwise(p)
    )
    return F.array_join(pieces, "")


def clean_rust(source: Column) -> Column:
    """Rust text without comments, string contents and macro bodies; line breaks stay where they were."""
    plain = F.translate(source, MARK + MARK_END + GENERICS + TOKEN + TOKEN_END + LEVEL + "\r", "")

    def blank(token: Column) -> Column:
        comment = token.startswith("//") | token.startswith("/*")
        quoted = F.when(token.startswith("'"), "'_'").when(comment, " ").otherwise('""')
        return F.concat(quoted, _newlines(token))

    # the pattern leaves a comment that holds another one open
    def cleaned(text: Column) -> Column:
        nested = lambda fast: F.when(F.contains(fast, F.lit("/*")), lexing.rust_code(text)).otherwise(fast)
        return let(_tokens_replaced(text, RUST_TOKEN, blank), nested)

    return let(let(plain, cleaned), lexing.without_macros)


def clean_typescript(source: Column, jsx: Column | bool = False) -> Column:
    """TypeScript text without comments, contents of template literals, regular expressions and markup; other strings stay.

    ``jsx`` says whether the file may hold markup. One pattern reads texts without bare slashes, ``${`` and markup.
    """
    jsx = F.lit(jsx) if isinstance(jsx, bool) else jsx
    plain = F.translate(source, TOKEN + TOKEN_END + "\r", "")

    def blank(token: Column) -> Column:
        comment = token.startswith("//") | token.startswith("/*")
        template = token.startswith("`")
        return F.when(comment, F.concat(F.lit(" "), _newlines(token))).when(
            template, F.concat(F.lit("``"), _newlines(token))).otherwise(token)

    def stateful(text: Column, fast: Column) -> Column:
        templates = F.contains(text, F.lit("`")) & F.contains(text, F.lit("${"))
        markup = jsx & F.contains(text, F.lit("<"))
        slash = F.contains(fast, F.lit("/")) & F.contains(F.regexp_replace(fast, F.lit(TS_STRING), F.lit("''")), F.lit("/"))
        return F.when(templates | markup | slash, lexing.typescript_code(text, jsx)).otherwise(fast)

    return let(plain, lambda text: let(_tokens_replaced(text, TS_TOKEN, blank), lambda fast: stateful(text, fast)))


def fact(kind: Column, pos: Column, name: Column, line: Column) -> Column:
    return F.struct(
        kind.cast("string").alias("fact"), pos.cast("int").alias("pos"),
        name.alias("name"), line.cast("int").alias("line"),
    )


def _marked(line: Column, index: Column) -> Column:
    """``line`` with its own number in front of each item keyword it holds."""
    mark = F.concat(F.lit(MARK), (index + 1).cast("string"), F.lit(MARK_END))
    impls = F.when(
        F.contains(line, F.lit("impl")),
        F.regexp_replace(line, F.lit(RUST_IMPL), F.concat(F.lit("$1"), mark, F.lit("$2"))),
    ).otherwise(line)
    return F.when(
        line.rlike(r"\b(fn|struct|trait)\s"), F.regexp_replace(impls, F.lit(RUST_ITEM), mark)
    ).otherwise(impls)


def rust_item_facts(clean: Column) -> Column:
    """Array of item facts, in source order.

    Lines carry their numbers into the text before it is cut at item keywords, so line numbers
    survive the cut without any ordering across rows.
    """
    # a name on a later line moves up to its keyword; the line breaks follow it
    joined = F.regexp_replace(clean, F.lit(RUST_SPLIT_ITEM), F.lit("$1 $3$2"))
    marked = F.array_join(F.transform(F.split(joined, "\n"), _marked), "\n")

    def item(piece: Column, index: Column) -> Column:
        def named(parts: Column) -> Column:
            body = F.get(parts, F.lit(1))
            head = F.ltrim(body)
            function, implementation = head.startswith("fn"), head.rlike(r"^(unsafe\s+)?impl\b")
            kind = (
                F.when(function, "Function").when(implementation, "Impl")
                .when(head.startswith("struct"), "Struct").when(head.startswith("trait"), "Trait")
            )
            name = (
                F.when(function, fn_name(head)).when(implementation, impl_name(head))
                .otherwise(F.regexp_extract(head, r"^(?:struct|trait)\s+((?:r#)?\w+)", 1))
            )
            return fact(kind, index, name, F.get(parts, F.lit(0)))

        return let(F.split(piece, MARK_END, 2), named)

    pieces = F.filter(F.split(marked, MARK), lambda p: F.contains(p, F.lit(MARK_END)))
    return F.filter(F.transform(pieces, item), lambda f: f["name"] != "")


def fn_name(segment: Column) -> Column:
    """Name of a function that has a body; empty for a bare signature."""
    plain = F.regexp_extract(segment, r"^fn\s+((?:r#)?\w++)[^;{\[]*+\{", 1)
    # array types hold semicolons and may hold braces
    flat = lexing.flattened(segment, "[", "]", "[]", LEVEL)
    listed = F.regexp_extract(flat, r"^fn\s+((?:r#)?\w+)[^;{]*\{", 1)
    return F.when(segment.rlike(r"^fn\s+(?:r#)?\w++[^;{\[]*+\["), listed).otherwise(plain)


def impl_name(segment: Column) -> Column:
    """The first bare type name of an ``impl`` header, or null.

    ``impl Tr for X`` gives ``Tr``; ``impl a::Tr for X`` gives ``X``; ``impl Foo<T>`` gives none.
    """
    header = F.regexp_extract(segment, r"^(?:unsafe\s+)?impl\b([^{]*)\{", 1)
    header = F.replace(header, F.lit("->"), F.lit("~"))
    header = lexing.flattened(header, "<", ">", GENERICS, LEVEL)
    header = F.regexp_replace(header, "^\\s*" + GENERICS, "")
    header = F.regexp_replace(header, r"(?s)\bwhere\b.*$", "")
    bare = F.transform(
        F.split(header, r"\sfor\s", 2), lambda side: F.regexp_extract(side, r"^\s*!?\s*([A-Za-z_]\w*)\s*$", 1)
    )
    return F.get(F.filter(bare, lambda name: (name != "") & ~name.isin(*RUST_PRIMITIVES)), F.lit(0))


def _listed(kind: str, found: Column) -> Column:
    return F.transform(found, lambda name, pos: fact(F.lit(kind), pos, name, F.lit(None)))


def rust_use_facts(clean: Column) -> Column:
    found = F.regexp_extract_all(clean, F.lit(RUST_USE), F.lit(1))
    return _listed("use", F.transform(found, lambda raw: F.trim(F.regexp_replace(raw, "^(use )+", ""))))


def rust_mod_facts(clean: Column) -> Column:
    return _listed("mod", F.regexp_extract_all(clean, F.lit(RUST_MOD), F.lit(1)))


def rust_facts(clean: Column) -> Column:
    return F.concat(rust_item_facts(clean), rust_use_facts(clean), rust_mod_facts(clean))


def ts_facts(clean: Column) -> Column:
    return _listed("specifier", F.regexp_extract_all(clean, F.lit(TS_SPECIFIER), F.lit(2)))
