"""Lexers and flat grammars of six languages.

A lexer turns a text into one character per token, its class.  Brackets (and indentation) nest; within one pair
of brackets every language here is regular once inner pairs are single symbols ``P`` ``S`` ``B`` (and ``I`` for
an indented block).  The grammar of a language is therefore one expression for the items of each kind of
bracket, an item being what lies between separators.  The permissible pairs of adjacent tokens are derived from
those expressions.

The grammars accept somewhat more than the languages: they are made to reject texts that no parser accepts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from tidemark.llm.automaton import Automaton

BAD = "!"  # a token class in no grammar: illegal characters, strings and comments that do not end
OPEN = {"(": "P", "[": "S", "{": "B", "<": "I"}
CLOSE = {")": "(", "]": "[", "}": "{", ">": "<"}


def _alternatives(node) -> tuple[set, set, set, bool]:
    """(first, last, pairs, may be empty) of a parsed expression over single characters."""
    first, last, pairs, empty = set(), set(), set(), True
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            f = l = {chr(arg)}  # noqa: E741
            p, e = set(), False
        elif name == "IN":
            f = l = {chr(a) for _, a in arg}  # noqa: E741
            p, e = set(), False
        elif name == "SUBPATTERN":
            f, l, p, e = _alternatives(arg[-1])  # noqa: E741
        elif name == "BRANCH":
            parts = [_alternatives(x) for x in arg[1]]
            f, l, p = (set().union(*(x[i] for x in parts)) for i in range(3))  # noqa: E741
            e = any(x[3] for x in parts)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            lo, hi, inner = arg
            f, l, p, e = _alternatives(inner)  # noqa: E741
            if hi != 1:
                p = p | {(a, b) for a in l for b in f}
            e = e or lo == 0
        else:
            raise ValueError(name)
        pairs |= p | {(a, b) for a in last for b in f}
        first |= f if empty else set()
        last = l | (last if e else set())
        empty &= e
    return first, last, pairs, empty


@dataclass(frozen=True, eq=False)
class Grammar:
    """items: expression of an item by kind of bracket ('' is the file itself); separators: of the same kinds."""

    name: str
    items: dict[str, str]
    separators: dict[str, str]
    tokens: str
    keywords: dict[str, str] = field(default_factory=dict)
    fold: bool = False

    @cached_property
    def lexer(self) -> re.Pattern:
        return re.compile(self.tokens, re.S | re.M)

    @lru_cache(maxsize=8)  # noqa: B019  one grammar a language, for the life of the process
    def pairs(self) -> frozenset[tuple[str, str]]:
        """Adjacent token classes that some item, or the border of a bracket, permits."""
        out: set[tuple[str, str]] = set()
        inside = {kind: _alternatives(re._parser.parse(p)) for kind, p in self.items.items()}
        shut = {v: k for k, v in CLOSE.items()}
        closed = {OPEN[k]: shut[k] for k in self.items if k}
        opened = {OPEN[k]: k for k in self.items if k}
        for kind, (first, last, pairs, empty) in inside.items():
            seps = self.separators[kind]
            ends = {s for s in seps}
            starts = {opened.get(f, f) for f in first}
            stops = {closed.get(x, x) for x in last}
            out |= {(closed.get(a, a), opened.get(b, b)) for a, b in pairs}
            out |= {(a, s) for a in stops for s in ends} | {(s, b) for s in ends for b in starts}
            out |= {(s, t) for s in ends for t in ends} if empty else set()
            if kind:
                out |= {(kind, b) for b in starts} | {(a, shut[kind]) for a in stops}
                out |= {(s, shut[kind]) for s in ends}
                if empty:
                    out |= {(kind, shut[kind])} | {(kind, s) for s in ends}
        return frozenset(out)


# ---------------------------------------------------------------------------------------------- JavaScript, TypeScript
_STR = r"""(?P<l>"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')"""
_NUM = r"(?P<num>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[nfFdDlL]?(?![\w$]))"
_C_COMMENT = r"(?P<skip>[ \t\f﻿ ]+|//[^\n\r]*|/\*.*?\*/)"
_JS_TOKENS = (
    _C_COMMENT
    + r"|(?P<nl>\r\n|\n|\r)|"
    + _STR
    + "|"
    + _NUM
    + r"|(?P<n>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)"
    + r"|(?P<A>=>)|(?P<e>\.\.\.)|(?P<d>\?\.(?!\d)|\.)|(?P<i>\+\+|--)|(?P<a>(?:\*\*|>>>|<<|>>|&&|\|\||\?\?|[-+*/%&|^])?=(?!=))"
    + r"|(?P<o>===|!==|==|!=|<=|>=|<<|>>>|>>|&&|\|\||\?\?|\*\*|[*/%&|^<>])|(?P<m>[-+])|(?P<u>[!~])|(?P<q>\?)|(?P<p>[()\[\]{},;:])"
)
_JS_WORDS = (
    dict.fromkeys("let var".split(), "k") | {"const": "Q", "function": "f", "class": "K", "export": "x", "import": "X", "default": "D", "if": "W", "for": "w", "while": "w", "with": "w", "switch": "w", "else": "L", "try": "T", "catch": "C", "finally": "Y", "do": "O", "case": "j", "new": "N"}
    | dict.fromkeys("return throw".split(), "R") | dict.fromkeys("break continue debugger".split(), "b") | dict.fromkeys("await typeof delete yield void".split(), "p") | dict.fromkeys("in instanceof".split(), "o") | {"extends": "h", "null": "l", "true": "l", "false": "l"}
)
_TS_WORDS = _JS_WORDS | {"enum": "K"}


def _js_items(ts: bool) -> dict[str, str]:
    pre = "[muipeN" + "M]*"
    typed = "(?:cE)?" if ts else ""
    gen = "g?" if ts else ""
    fn = f"M*fo?n?{gen}P{'(?:cV)?' if ts else ''}B"
    cls = f"Kn?{gen}(?:h{'(?:n(?:dn)*g?|V)' if not ts else 'V'})*B"
    post = "(?:P|S|dn|d[PS]|l|i" + ("|g|u" if ts else "") + ")*"
    oper = f"(?:{pre}(?:[nlPSBp]|{fn}|{cls}){post})"
    bare = f"(?:{pre}(?:[nlPSp]|{fn}){post})"  # no block at its end: a return type before a body
    # a colon is a label, a property or part of a ternary; TypeScript also has types after it
    bin_ = "(?:[omaAq" + ("c]|qc|qo" if ts else "c]") + ")"
    e = f"(?:{oper}(?:{bin_}{oper})*)"
    v = f"(?:{bare}(?:[omAqd]{bare})*)"
    method = f"M*o?[nlS]{'q?' if ts else ''}{gen}P{'(?:cV)?' if ts else ''}B" + ("?" if ts else "")
    head = f"(?:WP|wp?P|L|O|T|CP?|Y|nc|j{e}c|Dc)"
    decl = f"(?:(?:@P?)*x?D?M*(?:{fn}|{cls}" + ("|In" + gen + "(?:hV)*B" if ts else "") + f"|{method}))"
    imports = "X(?:l|P(?:P|dn)*|n(?:Fl)?|BFl|oonFl|tBFl|tnFl)|BFl|oonFl|x(?:B(?:Fl)?|o(?:on)?Fl" + ("|tB(?:Fl)?" if ts else "") + ")"
    const = f"Q[nBS]{'u?(?:cV)?' if ts else ''}a{e}" + (f"|x?M+Q[nBS](?:cV)?" if ts else "")
    simple = f"(?:R{e}?|bn?|x?M*k{e}|x?{const}|(?:xD)?{e}|{imports}" + (f"|x?M*tn{gen}a{e}|x?M*[nlS][qu]?c{e}" if ts else "|M+[nlS]") + "|M*[nlS](?:a" + e + ")?" + ")"
    block = f"(?:{head}|B|{decl})*{simple}?"
    arg = f"(?:(?:@P?)*M*{e}" + (f"|M*n?{gen}P(?:cV)?" if ts else "") + f"|[kQ][nSB]o{e}|k{e}|Q[nSB]a{e})?"
    sub = lambda s: s.replace("V", v).replace("E", e)
    return {"": sub(block), "{": sub(block), "(": sub(arg + "|[kQ][nSB]"), "[": sub(f"(?:{e}|M*n(?:o{e}|c{e}))?")}


# -------------------------------------------------------------------------------------------------------------- Java
_JAVA_TOKENS = (
    _C_COMMENT
    + r'|(?P<nl>\r\n|\n|\r)|(?P<text>"""[ \t]*\r?\n(?:[^\\]|\\.)*?""")|'
    + _STR
    + "|"
    + _NUM
    + r"|(?P<at>@[^\W\d][\w.]*)|(?P<n>[^\W\d][\w$]*|\$[\w$]*)"
    + r"|(?P<A>->)|(?P<e>\.\.\.)|(?P<d>\.|::)|(?P<i>\+\+|--)|(?P<a>(?:>>>|<<|>>|[-+*/%&|^])?=(?!=))"
    + r"|(?P<o>==|!=|<=|>=|<<|>>>|>>|&&|\|\||[*/%&|^<>])|(?P<m>[-+])|(?P<u>[!~])|(?P<q>\?)|(?P<p>[()\[\]{},;:])"
)
_JAVA_WORDS = (
    dict.fromkeys("public private protected static final abstract synchronized native transient volatile strictfp sealed".split(), "M") | dict.fromkeys("class interface enum record".split(), "K") | dict.fromkeys("extends implements throws permits".split(), "h") | dict.fromkeys("import package".split(), "X")
    | dict.fromkeys("if while for switch".split(), "W") | {"catch": "C", "else": "L", "try": "T", "finally": "Y", "do": "O", "case": "j", "default": "D", "new": "N", "instanceof": "o", "null": "l", "true": "l", "false": "l"}
    | dict.fromkeys("return throw assert".split(), "R") | dict.fromkeys("break continue".split(), "b")
)


def _java_items() -> dict[str, str]:
    ann = "(?:@P?)*"
    typ = "(?:n(?:dn)*g?(?:dng?)*S*)"
    lam = "(?:[nP]A)"
    oper = "(?:[muiP]*(?:Nn(?:dn)*g?(?:P|S+)B?|[nlP])(?:P|S|g|dn|dNn?|dN|i)*)"
    e = f"(?:{lam}*{oper}(?:[omaqc]{lam}*{oper})*(?:A(?:B|{oper}))?)"
    e = f"(?:{e}|{lam}+B|B|(?:{oper}[oma])+{lam}B|WP B|(?:{oper}a)?WPB)".replace(" ", "")
    mods = f"(?:M|D|{ann[3:-2]})*"
    var = f"{mods}{typ}e?nS*(?:[ac]{e})?"
    cls = f"{mods}Kng?P?(?:h{typ})*B"
    bare = f"{mods}g?{typ}?nPS*(?:h{typ})?"
    method = f"{bare}B"
    head = f"(?:WP|L|O|TP?|CP|Y|nc|j{e}[cA]|D[cA]|MP)"
    end = "[;,]"
    stmt = f"(?:{head}|B|{cls})*(?:(?:R{e}?|bn?|{e}|{var})?{end})?"
    member = f"(?:{cls}|{method}|M?B|{typ}B)*(?:(?:{cls}|{method}|{bare}|{var}|{e})?{end}|{e}|{ann}nP?B?)?"
    body = f"(?:{stmt}|{member})"
    top = f"(?:{ann}XM?n(?:dn)*(?:do)?;|(?:{cls}|{typ}B)*{end}?)"
    arg = f"(?:{e}|{var}|{mods}{typ}(?:o{typ})*n|n?a?{e}|{ann})?"
    return {"": top, "{": body, "(": arg, "[": f"(?:{e})?"}


# ---------------------------------------------------------------------------------------------------------------- Go
_GO_TOKENS = (
    r"(?P<skip>[ \t\f﻿]+|//[^\n\r]*)|(?P<block>/\*.*?\*/)"
    + r'|(?P<nl>\r\n|\n|\r)|(?P<l>"(?:[^"\\\n\r]|\\.)*"|`[^`]*`|\'(?:[^\'\\\n\r]|\\.)+\')|'
    + _NUM.replace("[nfFdDlL]?", "i?")
    + r"|(?P<n>[^\W\d]\w*)|(?P<e>\.\.\.)|(?P<d>\.)|(?P<i>\+\+|--)|(?P<a>:=|(?:<<|>>|&\^|[-+*/%&|^])?=(?!=))"
    + r"|(?P<o>==|!=|<=|>=|<<|>>|&&|\|\||&\^|[/%|<>])|(?P<m><-|[-+*&^])|(?P<u>[!~])|(?P<p>[()\[\]{},;:])"
)
_GO_WORDS = (
    dict.fromkeys("import package".split(), "X") | {"func": "f", "type": "t", "else": "L", "case": "j", "default": "D"} | {"var": "k", "const": "Q"} | dict.fromkeys("struct interface".split(), "K")
    | dict.fromkeys("if for switch select".split(), "W") | dict.fromkeys("return go defer".split(), "R") | dict.fromkeys("break continue goto fallthrough".split(), "b") | dict.fromkeys("range map chan".split(), "p")
)


def _go_items() -> dict[str, str]:
    oper = "(?:[mupeS]*(?:[nlPB]|fPP?|KB)(?:P|S|B|dn|dP|n|m?n|i)*)"
    oper = "(?:[mupeS]*(?:[nlPB]|f(?:P(?:P|[mS]*n(?:dn)*)?)?B?|KB)(?:P|S|B|dn|dP|i)*)"
    e = f"(?:{oper}(?:[omac]{oper}|c)*)"
    top = f"(?:Xn|X(?:n|d)?l|XP|f(?:P)?nS?P(?:{e}|P)?B?|kn(?:,n)*{e}?(?:a{e}(?:,{e})*)?|[kQ]P|Qn(?:,n)*{e}?a{e}(?:,{e})*|t(?:P|nS*a?{e}))?"
    ctl = f"(?:[WL]+(?:{e})?)+"
    stmt = f"(?:(?:j{e}?c?|Dc|nc)*(?:{ctl}|R(?:{e})?|bn?|[kQ](?:P|n{e}?(?:a{e})?)|tnS*a?{e}|n{e}l?|{e}[cl]?|c)?)"
    arg = f"(?:{e}|n{e}|n?l|n{e}a{e}|d?l)?"
    return {"": top, "{": stmt, "(": arg, "[": f"(?:{e}c?|c{e}?|n{e})?"}


# --------------------------------------------------------------------------------------------------------------- SQL
_SQL_TOKENS = (
    r"(?P<skip>[ \t\f\r\n﻿]+|--[^\n\r]*|/\*.*?\*/)"
    + r"|(?P<l>[eEnNxXbB]?'(?:[^']|'')*'|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?(?!\w)|\.\d+|\$\d+|:\w+|\?)"
    + r'|(?P<n>"(?:[^"]|"")*"|`[^`]*`|[^\W\d][\w$]*)|(?P<d>\.)|(?P<o><>|!=|<=|>=|\|\||::|:=|=>|[=<>/%])|(?P<m>[-+])|(?P<s>\*)|(?P<p>[()\[\],;])'
)
_SQL_WORDS = (
    {"select": "v", "from": "F", "join": "J", "where": "W", "group": "G", "by": "y", "having": "H", "order": "R", "as": "A", "insert": "Q", "into": "T", "values": "V", "update": "Z", "set": "E", "delete": "X", "with": "w", "null": "l", "true": "l", "false": "l", "not": "u", "create": "N"}
    | dict.fromkeys("inner left right full outer cross natural lateral".split(), "j") | dict.fromkeys("on using".split(), "O") | dict.fromkeys("limit offset fetch".split(), "L") | dict.fromkeys("union except intersect minus".split(), "U") | dict.fromkeys("distinct all".split(), "D")
    | dict.fromkeys("and or like ilike in between is".split(), "o") | dict.fromkeys("asc desc".split(), "x") | dict.fromkeys("alter drop truncate grant revoke begin commit rollback comment analyze explain use merge declare call exec execute".split(), "C")
    | dict.fromkeys("default primary key references unique check foreign constraint table view index if exists cascade returning conflict do nothing".split(), "r") | {"case": "c", "when": "h", "then": "t", "else": "e", "end": "z"}
)


def _sql_items() -> dict[str, str]:
    atom = "(?:[nlP]|s|r?nP)(?:l|P|d[ns]|S)*"
    case = "c(?:@)?(?:h@t@)+(?:e@)?z"
    oper = f"(?:[muD]*(?:r?P|{atom}|#))"
    e0 = f"(?:{oper}(?:(?:[oms]|ou|uo){oper})*)"
    flat = e0.replace("#", "n")
    e = e0.replace("#", case.replace("@", flat))
    col = f"{e}(?:A?n)?"
    table = "(?:n(?:dn)*|P|nP)(?:A?n)?"
    joins = f"(?:,{table}|j*J{table}(?:O{e})?)*"
    order = f"{e}x?(?:n{{1,2}})?(?:,{e}x?)*"
    sel = f"v(?:D)?{col}(?:,{col})*(?:T{table})?(?:F{table}{joins})?(?:W{e})?(?:Gy{e}(?:,{e})*)?(?:H{e})?"
    query = f"(?:{sel}|P|VP(?:,P)*)(?:UD?(?:{sel}|P))*(?:Ry{order})?(?:L[lnP]n{{0,2}})*"
    with_ = "(?:wn?nP?AP(?:,nP?AP)*)?"
    ret = f"(?:r(?:{e}|s)(?:,{e})*)?"
    ins = f"QT?n(?:dn)*P?(?:VP(?:,P)*|{with_}{sel}(?:UD?(?:{sel}|P))*(?:Ry{order})?(?:L[lnP]n{{0,2}})*|rV)(?:Or?P?r*(?:ZE{e}(?:,{e})*)?|OP?[rn]*)?{ret}"
    upd = f"Zn(?:dn)*(?:A?n)?E{e}(?:,{e})*(?:F{table}{joins})?(?:W{e})?{ret}"
    dele = f"XFn(?:dn)*(?:A?n)?(?:W{e})?{ret}"
    rest = "(?:[nrlPEOAFTyDJod,x]|dn)*"
    create = f"N[nrDou]*n(?:dn)*(?:P{rest}(?:A{query})?|A{query}|On(?:dn)*{rest}P{rest})|Nn{{2,4}}(?:dn)*{rest}|C[nrDOu]*(?:n(?:dn)*)?(?:P)?(?:[nrlPEOAFTyDJod,x]|dn)*(?:A{query})?"
    top = f"(?:{with_}(?:{query}|{ins}|{upd}|{dele})|{create})?"
    coldef = "[nr](?:[nrPlu]|dn|rO[XZ]r)*"
    args = f"(?:{col}x?|{coldef}|{with_}{query}|(?:n?yE?{e})?(?:Ry{order})?|nA{e}|{e}A(?:nP?)+|{e}F{e})?"
    return {"": top, "(": args.replace("yE?", "y"), "[": f"(?:{e})?"}


# ------------------------------------------------------------------------------------------------------------ Python
_PY_TOKENS = (
    r"(?P<skip>[ \t\f]+|#[^\n\r]*|\\\r?\n)|(?P<nl>\r\n|\n|\r)"
    + r'|(?P<l>(?i:[rbuft]{0,2})(?:"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?!"")(?:[^"\\\n\r]|\\(?:\r\n|.))*"|\'(?!\'\')(?:[^\'\\\n\r]|\\(?:\r\n|.))*\'))'
    + r"|(?P<num>0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?(?![\w]))"
    + r"|(?P<n>[^\W\d]\w*)|(?P<dots>\.\.\.)|(?P<d>\.)|(?P<A>->)|(?P<a>:=|(?:\*\*|//|>>|<<|[-+*/%@&|^])?=(?!=))"
    + r"|(?P<o>==|!=|<=|>=|<<|>>|//|[/%&|^<>])|(?P<s>\*\*|\*)|(?P<m>[-+])|(?P<u>~)|(?P<at>@)|(?P<p>[()\[\]{},;:])"
)
_PY_WORDS = (
    {"def": "D", "class": "K", "if": "W", "else": "E", "elif": "f", "while": "w", "with": "h", "for": "F", "try": "T", "except": "x", "finally": "y", "import": "X", "from": "M", "as": "z", "lambda": "L", "async": "Y", "await": "p", "not": "u", "None": "l", "True": "l", "False": "l", "yield": "g"}
    | dict.fromkeys("return raise del assert global nonlocal".split(), "R") | dict.fromkeys("pass break continue".split(), "b") | dict.fromkeys("and or in is".split(), "o")
)


def _py_items() -> dict[str, str]:
    star = "s?"
    oper = "(?:[mup]*(?:n|l+|P|S|B)(?:P|S|dn)*)"
    lam = "(?:L(?:s?n(?:a@)?|,|s|o)*c)"
    flat = f"(?:{oper}(?:(?:[omsv]|ou|uo){oper})*)"
    one = f"(?:{lam.replace('@', flat)}*{flat})"
    e = f"(?:{one}(?:W{one}E{one})*(?:a{one}(?:W{one}E{one})*)*)"
    es = f"(?:{star}{e}(?:,{star}{e})*,?)"
    # what stands before '=' ends in a name, an index or an attribute, or is a tuple or list
    plain = f"(?:{one}(?:W{one}E{one})*)"
    values = f"(?:{star}{plain}(?:,{star}{plain})*,?)"
    target = "(?:n|P|S|(?:n|l+|P|S|B)(?:P|S|dn)*(?:S|dn))"
    assign = f"(?:{star}{target}(?:,{star}{target})*,?a)"
    # targets, 'in' and source read as one comparison; a comma between targets ends the item
    comp = f"(?:Y?F{es}|W{e})"
    tail = "(?:I|#)"
    small = f"(?:R(?:{es}(?:M{e})?)?|b|g(?:M?{es})?|X(?:n(?:dn)*(?:zn)?,?)+|M(?:d*n(?:dn)*|d+)X(?:P|s|(?:n(?:zn)?,?)+)|{assign}*(?:{values}|g(?:M?{es})?)|{target}c{plain}(?:a(?:{values}|g(?:M?{es})?))?|nnS?a{e})"
    line = f"{small}(?:;{small})*;?"
    head = f"(?:Y?DnS?P(?:A{e})?c|KnS?P?c|[Wfw]{e}c|E(?:c)|Y?F{es}c|Y?h{e}(?:zn(?:dn)*|zP)?(?:,{e}(?:zn)?)*c|T(?:c)|xs?(?:{es}(?:zn)?)?c|y(?:c)|n{es}(?:z[nP])?(?:W{e})?c)"
    body = f"(?:v{e}|{head}(?:I|{line})|{line})?"
    # the commas of a lambda's own parameters end items too
    begun = f"L(?:s?n(?:a{flat})?|s|o)"
    arg = f"(?:{begun}|{star}{e}(?:c{e})?(?:[aA]{e})?{comp}*|s|o|gM?{es}?|{e}(?:z{e})|n(?:zn)?|s{e}|{e}c(?:{e})(?:a{e})?|sn(?:c{e})?|{lam.replace('@', flat)}{e})?"
    sub = f"(?:{begun}|{star}{e}{comp}*|(?:{e})?c(?:{e})?(?:c(?:{e})?)?)?"
    brace = f"(?:{begun}|{star}{e}(?:c{e})?{comp}*|s{e})?"
    return {"": body, "<": body, "(": arg, "[": sub, "{": brace}


GRAMMARS = {
    "py": Grammar("py", _py_items(), {"": "\n", "<": "\n", "(": ",", "[": ",", "{": ","}, _PY_TOKENS, _PY_WORDS),
    "js": Grammar("js", _js_items(False), {"": ";,", "{": ";,", "(": ";,", "[": ","}, _JS_TOKENS, _JS_WORDS),
    "ts": Grammar("ts", _js_items(True), {"": ";,", "{": ";,", "(": ";,", "[": ","}, _JS_TOKENS, _TS_WORDS),
    "java": Grammar("java", _java_items(), {"": ";,", "{": ";,", "(": ";,", "[": ","}, _JAVA_TOKENS, _JAVA_WORDS),
    "go": Grammar("go", _go_items(), {"": ";", "{": ";,", "(": ";,", "[": ","}, _GO_TOKENS, _GO_WORDS),
    "sql": Grammar("sql", _sql_items(), {"": ";", "(": ",", "[": ","}, _SQL_TOKENS, _SQL_WORDS, fold=True),
}
#: Python: what an item may follow that begins with one of these words, and what must follow one.
PY_AFTER = {"x": "Tx", "y": "TxE", "f": "Wf", "E": "WfwFxY"}
PY_BEFORE = {"T": "xy", "v": "vDK"}
#: Extensions whose files are checked.
LANGUAGE = {".py": "py", ".js": "js", ".ts": "ts", ".java": "java", ".go": "go", ".sql": "sql"}

_ENDS = set("nlPSBibRp)]}ug")
_MODIFIERS = set("static public private protected readonly abstract declare async get set override accessor".split())


_GENERIC = re.compile(r"[<>]|&&|\|\||[^\w$ ,.\[\]|?&'\"@{}:;\n\r\t()=<>]")


def _generic_ends(text: str) -> dict[int, int]:
    """Where each list of type arguments ends, by where it begins: names and their like in balanced signs."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in _GENERIC.finditer(text):
        c, at = m.group(), m.start()
        if c == "<":
            open_.append(at)
        elif c != ">":
            open_.clear()
        elif open_ and text[at - 1] != "=":
            out[open_.pop()] = at + 1
    return out


def _template_end(text: str, at: int) -> int:
    """Where the template literal that begins at ``at`` ends, with the expressions inside it; -1 if it does not."""
    i, stack = at + 1, ["`"]
    while i < len(text):
        c = text[i]
        if stack[-1] == "`":
            if c == "\\":
                i += 1
            elif c == "`":
                stack.pop()
                if not stack:
                    return i + 1
            elif text.startswith("${", i):
                stack.append("{")
                i += 1
        elif c == "{":
            stack.append("{")
        elif c == "}":
            stack.pop()
        elif c == "`":
            stack.append("`")
        elif c in "\"'":
            m = re.compile(r"%s(?:[^%s\\\n]|\\.)*%s" % (c, c, c)).match(text, i)
            if m:
                i = m.end() - 1
        i += 1
    return -1


_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-z]*")


def lex(lang: str, text: str) -> tuple[str, list[int]]:
    """(classes, lines): one character and the 1-based line of each token of a text."""
    g = GRAMMARS[lang]
    if lang == "py":
        return _lex_python(g, text)
    words, fold = g.keywords, g.fold
    scan = g.lexer.match
    out: list[str] = []
    lines: list[int] = []
    at, line, broke, n = 0, 1, False, len(text)
    js, ts = lang in ("js", "ts"), lang == "ts"
    typed = lang in ("ts", "java")
    generics = _generic_ends(text) if typed else {}

    def put(c: str) -> None:
        out.append(c)
        lines.append(line)

    def last() -> str:
        return out[-1] if out else ""

    while at < n:
        if js and text[at] == "`":
            end = _template_end(text, at)
            if broke and last() in _ENDS:
                put(";")
            broke = False
            put("l" if end > 0 else BAD)
            end = end if end > 0 else n
            line, at = line + text.count("\n", at, end), end
            continue
        if js and text[at] == "/" and (not out or last() not in "nl)]}i") and (m := _REGEX.match(text, at)):
            put("l")
            at, broke = m.end(), False
            continue
        m = scan(text, at)
        if m is None or m.end() == at:
            put(BAD)
            at, broke = at + 1, False
            continue
        kind, s = m.lastgroup, m.group()
        if kind in ("skip", "block"):
            k = s.count("\n")
            if k:
                broke = True
                if lang == "go" and last() in _ENDS:
                    put(";")
                line += k
            at = m.end()
            continue
        if kind == "nl":
            if lang == "go" and out and last() in _ENDS:
                put(";")
            line, at, broke = line + 1, m.end(), True
            continue
        c = {"num": "l", "text": "l", "s": "s"}.get(kind, kind)
        if kind == "p":
            c = {":": "c"}.get(s, s)
        elif kind == "at":
            c = "K" if s == "@interface" else "@"
        elif kind == "n":
            w = words.get(s.lower() if fold else s, "n")
            if lang != "go" and lang != "sql" and last() == "d":
                w = "n"
            elif js:
                w = _js_word(s, w, last(), text, m.end(), ts)
            elif lang == "java" and s in ("record", "sealed", "permits") and not re.compile(r"\s+[A-Za-z_]").match(text, m.end()):
                w = "n"
            elif lang == "sql" and last() == "d":
                w = "n"
            c = w
        elif typed and s[0] == "<" and last() in "nMAd" + ("f" if ts else "") and (end := generics.get(at, -1)) > 0:
            if re.compile(r"\s*(?:[\w$@({\[)\],;=>|&?:]|$)").match(text, end) and not (last() == "n" and re.compile(r"<\s*\d").match(text, at)):
                put("g")
                line, at, broke = line + text.count("\n", at, end), end, False
                continue
        elif lang == "java" and s[0] == "<" and last() in (";", "{", "}", "M", "@") and (end := generics.get(at, -1)) > 0:
            put("g")
            at = end
            continue
        if js and broke and last() in _ENDS - set("p") and (c in "nlkQfKxXWwOTRbjDNMItpu@{" or c == "i") and not (c == "{" and last() in ")"):
            put(";")
        put(c)
        at, broke = m.end(), False
    if lang == "go" and out and out[0] != "X":  # a Go file begins with its package clause
        out[0] = BAD
    return "".join(out), lines


def _js_word(s: str, w: str, before: str, text: str, end: int, ts: bool) -> str:
    """Class of a word: reserved, or one that is a keyword only in its place."""
    nxt = text[end : end + 40].lstrip(" \t")
    if w != "n":
        # reserved words are names of properties: `default: 1`, `delete(x) {}`
        if before in ("{", ",", "M") and nxt[:1] in (":", "(") and w not in "WwCNTOYjDRXpf":
            return "n"
        return w
    name = re.compile(r"[\w$\"'#\[{*]").match(nxt)
    if s[0] == "@":
        return "@"
    if s == "from" and before in ("n", "}", "o", "X", "s") and nxt[:1] in "\"'":
        return "F"
    if s in ("of", "as", "satisfies", "is") and before in ("n", "]", "}", ")", "l", "o") and (name or nxt[:1] in "(`<") and not (s == "of" and nxt[:1] == "("):
        return "o"
    if s == "as" and before == "o":
        return "o"
    if s in _MODIFIERS and (name or (s == "async" and nxt[:1] == "(") or nxt[:1] == "<") and before not in ("d", "k", "Q") and not re.compile(r"(?:in|of|instanceof|as)\b").match(nxt):
        if s in ("get", "set", "static", "accessor") or s == "async" or ts:
            return "M"
    if ts and before not in ("d", "k", "Q", "n") and name:
        if s in ("interface", "namespace", "module") and re.compile(r"[\w$\"']").match(nxt):
            return "I"
        if s == "type" and re.compile(r"[\w${]").match(nxt):
            return "t"
        if s in ("keyof", "infer", "unique", "asserts"):
            return "p"
    if ts and s == "implements":
        return "h"
    return "n"


_FORMATTED = re.compile(r"(?i:(?:[ft]r?|r[ft]))(?P<q>\"\"\"|'''|\"|')")
_QUOTED = re.compile(r"(?i:[rbu]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')", re.S)


def _formatted_end(text: str, at: int, quote: str) -> int:
    """Where a formatted string ends whose text begins at ``at``, with the expressions inside it; -1 if it does not."""
    i, n = at, len(text)
    stack: list[str] = [quote]  # quotes of texts, and '{' of expressions, with ':' for the format after one
    while i < n:
        top = stack[-1]
        if top in ("{", "("):
            c = text[i]
            if (m := _FORMATTED.match(text, i)) and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")):
                stack.append(m.group("q"))
                i = m.end()
                continue
            if c in "\"'":
                m = _QUOTED.match(text, i)
                if not m:
                    return -1
                i = m.end()
                continue
            if c in "([{":
                stack.append("(")
            elif c in ")]}":
                stack.pop()
            elif c == ":" and top == "{" and text[i + 1 : i + 2] != "=":
                stack[-1] = ":"
            i += 1
        elif top == ":":
            if text[i] == "{":
                stack.append("{")
            elif text[i] == "}":
                stack.pop()
            elif text[i] in "\n":
                return -1
            i += 1
        elif text.startswith(top, i):
            stack.pop()
            i += len(top)
            if not stack:
                return i
        elif text[i] == "\\":
            i += 2
        elif text[i] == "{":
            if text.startswith("{{", i):
                i += 2
            else:
                stack.append("{")
                i += 1
        elif text[i] in "\r\n" and len(top) == 1:
            return -1
        else:
            i += 1
    return -1


def _lex_python(g: Grammar, text: str) -> tuple[str, list[int]]:
    words, scan = g.keywords, g.lexer.match
    out: list[str] = []
    lines: list[int] = []
    text = text[1:] if text[:1] == "﻿" else text
    stack, depth, at, line, n, fresh = [0], 0, 0, 1, len(text), True

    def put(c: str) -> None:
        out.append(c)
        lines.append(line)

    while at < n:
        if fresh and not depth:
            m = re.compile(r"[ \t\f]*").match(text, at)
            width = 0
            for c in m.group():
                width = 0 if c == "\f" else (width // 8 + 1) * 8 if c == "\t" else width + 1
            at = m.end()
            fresh = False
            if at < n and text[at] not in "#\r\n":
                if width > stack[-1]:
                    # a block is part of the line that opens it, so its line break goes
                    if out and out[-1] == "\n":
                        out.pop()
                        lines.pop()
                    else:
                        put(BAD)
                    stack.append(width)
                    put("<")
                while width < stack[-1]:
                    stack.pop()
                    put(">")
                    put("\n")
                if width != stack[-1]:
                    put(BAD)
            continue
        if text[at] in "fFtTrR" and (m := _FORMATTED.match(text, at)) and (end := _formatted_end(text, m.end(), m.group("q"))) > 0:
            put("l")
            line, at = line + text.count("\n", at, end), end
            continue
        m = scan(text, at)
        if m is None or m.end() == at:
            put(BAD)
            at += 1
            continue
        kind, s = m.lastgroup, m.group()
        at = m.end()
        if kind == "skip":
            line += s.count("\n")
            continue
        if kind == "nl":
            if not depth:
                if out and out[-1] not in "\n<":
                    put("\n")
                fresh = True
            line += 1
            continue
        c = {"num": "l", "dots": "l", "at": "v"}.get(kind, kind)
        if kind == "p":
            c = {":": "c"}.get(s, s)
            depth = depth + 1 if s in "([{" else max(0, depth - 1) if s in ")]}" else depth
        elif kind == "n":
            c = "n" if out and out[-1] == "d" and s != "import" else words.get(s, "n")
        put(c)
        line += s.count("\n")
    if not depth:
        if out and out[-1] not in "\n>":
            put("\n")
        for _ in stack[1:]:
            put(">")
            put("\n")
    return "".join(out), lines


def accepts(lang: str, kind: str, item: str) -> bool:
    """Whether an item of a bracket of this kind follows the grammar, in time linear in the item.

    An item may have the separator that ends it; only Java cares whether it has.
    """
    if lang != "java" and item[-1:] and item[-1] in GRAMMARS[lang].separators[kind]:
        item = item[:-1]
    elif lang == "java" and kind in ("(", "[") and item[-1:] in (";", ","):
        item = item[:-1]
    return _compiled(lang, kind).fullmatch(item)


@lru_cache(maxsize=64)
def _compiled(lang: str, kind: str) -> Automaton:
    return Automaton(GRAMMARS[lang].items[kind])
