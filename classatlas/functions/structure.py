"""Contract of a Java source file as one column expression.

A small Arrow-batched helper walks the tokens of a text, keeps nesting depths
only and cuts out the declarations, each with a mask of its header in which
everything nested is overwritten by fillers. All that follows is column
expressions: one pattern over a mask lays out its header whatever the nesting.
The work stays inside one row, so there is no shuffle.

Input that is not Java gives empty lists; blank input gives NULL.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classatlas.functions.names import strip_space
from classatlas.functions.text import collapse_space, let
from classatlas.schemas import CLASS_STRUCTURE, MEMBER

# Lexical forms and keywords of the Java language
_TOKEN = (
    r'"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+(?:"{3})?'
    r'|"(?:[^"\\\n]|\\.)*+"?'
    r"|'(?:[^'\\\n]|\\.)*+'?"
    r"|//[^\n]*+"
    r"|/\*[\s\S]*?(?:\*/|\Z)"
    r"|[{}()\[\]<>;,=]"
    r"|[^{}()\[\]<>;,=\"'/]++|/"
)
_KINDS = r"@\s*interface|class|interface|enum|record"
_MODIFIERS = (
    r"(?:public|protected|private|abstract|static|final|strictfp|default|synchronized"
    r"|native|transient|volatile|sealed|non-sealed)(?![\p{L}\p{N}_$])"
)
_TYPE_WORD = rf"(?:^|\s)({_KINDS})\s"

# mask fillers: text nested in brackets, and comments
_NESTED = "\u0001"
_REMARK = "\u0002"
_SPLIT = "\u0003"

_GAP = rf"[\s{_REMARK}]"
_NAME = r"[\p{L}\p{N}_$]+"
_ARGS = rf"\({_NESTED}*\)"
_ANGLES = rf"<{_NESTED}*>"
_NOTE = rf"@(?!\s*interface\b)\s*{_NAME}(?:\.{_NAME})*+(?:\s*{_ARGS})?+"
_PREFIX = rf"((?:{_NOTE}|{_MODIFIERS})(?:{_GAP}*+(?:{_NOTE}|{_MODIFIERS}))*+)?+({_GAP}*+)"


def _clause(word: str, *following: str) -> str:
    until = "".join(rf"{w}\b|" for w in following)
    return rf"({word}\b[\s\S]*?(?={_GAP}*+(?:{until}$)))?({_GAP}*+)"


# pattern parts alternate "part, gap"; the layout gives what precedes each part
_TYPE_HEADER = (
    rf"^{_PREFIX}({_KINDS})({_GAP}+)({_NAME})({_GAP}*+)({_ANGLES})?+({_GAP}*+)({_ARGS})?+({_GAP}*+)"
    + _clause("extends", "implements", "permits")
    + _clause("implements", "permits")
    + _clause("permits")
)
_TYPE_LAYOUT = ("", " ", " ", "", "", " ", " ", " ")
_CALL_HEADER = (
    rf"^{_PREFIX}({_ANGLES})?+({_GAP}*+)((?:{_NOTE})(?:{_GAP}*+(?:{_NOTE}))*+)?+({_GAP}*+)"
    rf"(?:([^()]+?)({_GAP}+|(?<=[>\]]){_GAP}*))?({_NAME})({_GAP}*+)({_ARGS})({_GAP}*+)"
    rf"(\[{_NESTED}*\](?:\s*\[{_NESTED}*\])*+)?+({_GAP}*+)(throws\b[\s\S]*?(?={_GAP}*+$))?({_GAP}*+)"
)
_CALL_LAYOUT = ("", "", " ", " ", " ", "", " ", " ")

_MEMBERS = T.ArrayType(MEMBER)
_SCAN = T.StructType([
    T.StructField("comments", T.ArrayType(T.StringType())),
    T.StructField("segments", T.ArrayType(T.StructType([
        T.StructField("level", T.IntegerType()),
        T.StructField("ender", T.StringType()),
        T.StructField("constant", T.BooleanType()),
        T.StructField("owner", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("header", T.StringType()),
        T.StructField("mask", T.StringType()),
    ]))),
])


def _cut(text: str) -> tuple[list[str], list[tuple]]:
    """Comments and declarations of one file.

    A declaration runs from its first code token to ``;`` or to an opening body
    at file level, to ``;`` or a closing body at type level, and to ``,`` between
    enum constants. Comments before its first code token lead it; one that does
    not start its own line cuts off those before it.
    """
    comments, found, lead, mask = [], [], [], []
    braces = parens = angles = 0
    begin = end = -1
    word = owner = ""
    constants = assigned = in_body = False
    fresh_line = True
    for match in re.finditer(_TOKEN, text):
        token, at = match.group(), match.start()
        starts_line = fresh_line
        fresh_line = (starts_line or "\n" in token) and not token[token.rfind("\n") + 1 :].strip()
        if token.startswith(("//", "/*")):
            comments.append(token.strip())
            if begin < 0:
                if starts_line:
                    lead.append(comments[-1])
                else:
                    lead = []
            elif not (in_body or assigned):
                mask.append(_REMARK * len(token))
            continue
        level = braces if braces < 2 and not parens else -1
        blank = token.isspace()
        opens = token == "{"
        closes_body = token == "}" and braces == 2 and not (parens or assigned or constants)
        ends_constant = constants and level == 1 and token in ",;}"
        boundary = (
            closes_body
            or ends_constant
            or (level >= 0 and token == ";")
            or (level == 0 and opens)
            or (level == 1 and token == "}")
        )
        if boundary:
            if begin >= 0 and not (token == "}" and level == 1 and not ends_constant):
                header = "".join(mask)
                until = end if ends_constant or opens else match.end()
                found.append((
                    max(level, 0) if not closes_body else 1, token, ends_constant, owner,
                    "\n".join(lead) or None,
                    None if closes_body or opens else text[begin:until],
                    text[begin : begin + len(header)], header,
                ))
            if level == 0 and opens:
                owner, constants = word, word == "enum"
            elif level == 1 and token == "}":
                owner, constants = "", False
            elif token == ";":
                constants = False
            lead, mask, begin, end, angles = [], [], -1, -1, 0
            assigned = in_body = False
            word = ""
        elif level == 1 and opens:
            in_body = True
            begin, end = (at if begin < 0 else begin), match.end()
        elif level == 1 and (token == "=" or (owner == "@interface" and token.rstrip().endswith(" default"))):
            assigned = True
            begin, end = (at if begin < 0 else begin), match.end()
        elif not blank or begin >= 0:
            if not blank:
                if begin < 0:
                    begin = match.end() - len(token.lstrip())
                end = at + len(token.rstrip())
                if level == 0 and not word:
                    kind = re.search(_TYPE_WORD, token)
                    word = re.sub(r"\s", "", kind.group(1)) if kind else ""
            if not (in_body or assigned):
                shown = text[max(at, begin) : match.end()]
                edge = (
                    (token in "([" and not parens) or (token in ")]" and parens == 1)
                    if token in "()[]"
                    else not parens and ((token == "<" and not angles) or (token == ">" and angles == 1))
                )
                nested = angles > 0 if token in "()[]" else angles > 0 and not edge
                if not parens and token == "<":
                    angles += 1
                elif not parens and token == ">":
                    angles = max(angles - 1, 0)
                hidden = nested or (parens > 0 and not edge)
                mask.append(_NESTED * len(shown) if hidden else shown)
        if token in "([":
            parens += 1
        elif token in ")]":
            parens = max(parens - 1, 0)
        elif opens:
            braces += 1
        elif token == "}":
            braces = max(braces - 1, 0)
    return comments, found


@F.pandas_udf(_SCAN)
def _scan(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_cut(text or "") for text in texts], columns=["comments", "segments"])


def _blank(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?U)^\s*$"))


def _lay_out(text: Column, mask: Column, pattern: str, layout: tuple[str, ...]) -> Column:
    """Join the parts the pattern finds in the mask, taken from the real text.

    Gaps vanish, except that a comment in a gap is a part of its own.
    """
    groups = _SPLIT.join(f"${i + 1}" for i in range(2 * len(layout)))
    leads = F.array(*[F.lit(lead) for lead in layout])

    def joined(parts: Column) -> Column:
        def append(s: Column, i: Column) -> Column:
            part_length = F.length(F.get(parts, i * 2))
            gap_length = F.length(F.get(parts, i * 2 + 1))
            part = F.substr(text, s["pos"] + 1, part_length)
            gap = F.substr(text, s["pos"] + 1 + part_length, gap_length)
            lead = F.when(s["line"] == "", F.lit("")).otherwise(F.get(leads, i))
            line = F.when(part_length == 0, s["line"]).otherwise(F.concat(s["line"], lead, part))
            return F.struct(
                (s["pos"] + part_length + gap_length).alias("pos"),
                F.when(_blank(gap), line)
                .otherwise(F.concat_ws(" ", F.nullif(line, F.lit("")), strip_space(gap))).alias("line"),
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.lit(len(layout) - 1)),
            F.struct(F.lit(0).alias("pos"), F.lit("").alias("line")),
            append,
            lambda s: strip_space(s["line"]),
        )

    return let(F.split(F.regexp_replace(mask, pattern + r"[\s\S]*", groups), _SPLIT), joined)


def _member(declaration: Column, segment: Column) -> Column:
    return F.struct(declaration.alias("declaration"), segment["comment"].alias("comment"))


def class_structure(text: Column) -> Column:
    """Package, imports, declaration, comments, fields and methods of one file.

    With several top-level types the last one gives declaration and comment,
    fields and methods accumulate.
    """
    # a cheap test first: most declarations are decided by it
    def is_type(s: Column) -> Column:
        return F.rlike(s["mask"], F.lit("class|interface|enum|record")) & F.rlike(
            s["mask"], F.lit(rf"^{_PREFIX}(?:{_KINDS}){_GAP}+{_NAME}")
        )

    def is_call(s: Column) -> Column:
        return F.contains(s["mask"], F.lit("(")) & F.rlike(s["mask"], F.lit(_CALL_HEADER))

    def assemble(scan: Column) -> Column:
        segments = scan["segments"]
        statements = F.transform(
            F.filter(segments, lambda s: (s["level"] == 0) & (s["ender"] == ";")),
            lambda s: s["source"],
        )
        package = F.filter(
            F.transform(
                statements, lambda x: F.regexp_extract(x, r"(?:^|\s)package\s+([^\s;]+)\s*;$", 1)
            ),
            lambda x: x != "",
        )
        imports = F.filter(
            F.transform(
                statements,
                lambda x: F.regexp_extract(
                    x, r"^import\s+(?:static\s+)?(?:[^\s;*]+\.\s*(?=\*))?([^\s;]+)\s*;$", 1
                ),
            ),
            lambda x: x != "",
        )
        types = F.transform(
            F.filter(segments, lambda s: (s["level"] == 0) & (s["ender"] == "{") & is_type(s)),
            lambda s: F.struct(
                _lay_out(s["header"], s["mask"], _TYPE_HEADER, _TYPE_LAYOUT).alias("line"),
                s["comment"].alias("comment"),
            ),
        )
        members = F.filter(
            segments,
            lambda s: (s["level"] == 1) & (s["owner"] != "") & (s["constant"] | ~is_type(s)),
        )
        fields = F.transform(
            F.filter(members, lambda s: s["constant"] | ((s["ender"] == ";") & ~is_call(s))),
            lambda s: _member(collapse_space(s["source"]), s),
        )
        methods = F.transform(
            F.filter(members, lambda s: ~s["constant"] & is_call(s)),
            lambda s: _member(
                F.when(s["owner"] == "@interface", collapse_space(s["source"])).otherwise(
                    _lay_out(s["header"], s["mask"], _CALL_HEADER, _CALL_LAYOUT)
                ),
                s,
            ),
        )
        last_type = F.try_element_at(types, F.lit(-1))
        return F.struct(
            F.coalesce(F.try_element_at(package, F.lit(-1)), F.lit("")).alias("package"),
            imports.alias("imports"),
            F.coalesce(last_type["line"], F.lit("")).alias("class_declaration"),
            last_type["comment"].alias("class_comment"),
            scan["comments"].alias("comments"),
            fields.cast(_MEMBERS).alias("fields"),
            methods.cast(_MEMBERS).alias("methods"),
        )

    return F.when(~_blank(text), let(_scan(text), assemble).cast(CLASS_STRUCTURE))


def has_member(members: Column, needle: str) -> Column:
    """Whether some declaration in ``fields`` or ``methods`` contains a text."""
    return F.exists(members, lambda m: F.contains(m["declaration"], F.lit(needle)))
