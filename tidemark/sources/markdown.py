"""Markdown texts to sections: headings outside fences, unique anchors, parents, references and links."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_LINK = re.compile(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)")
_CODE = re.compile(r"`([^`\n]+)`")
SCHEMA = "doc_id string, heading string, level int, anchor string, start int, `end` int, parent int, code_refs array<string>, links array<string>, prose string"


def _slug(text: str, taken: dict[str, int]) -> str:
    base = re.sub(r"[^\w\- ]", "", text.lower()).strip().replace(" ", "-") or "section"
    n = taken.get(base, 0)
    taken[base] = n + 1
    return f"{base}-{n}" if n else base


def split_sections(text: str) -> list[dict]:
    """The sections of a text in order; what stands before the first heading is section 0 of level 0.

    ``parent`` is the number of the section above, -1 for none.  Anchors are unique within the text.
    """
    out: list[dict] = [{"heading": "", "level": 0, "start": 1, "lines": []}]
    fence = ""
    lines = text.split("\n")
    for i, line in enumerate(lines, 1):
        f = _FENCE.match(line)
        if f and (not fence or (f[1][0] == fence[0] and len(f[1]) >= len(fence))):
            fence = "" if fence else f[1]
        h = None if fence or f else _HEADING.match(line)
        if h:
            out.append({"heading": h[2], "level": len(h[1]), "start": i, "lines": []})
        else:
            out[-1]["lines"].append((line, bool(fence or f)))
    taken: dict[str, int] = {}
    stack: list[int] = []
    for i, s in enumerate(out):
        while stack and out[stack[-1]]["level"] >= s["level"]:
            stack.pop()
        s["parent"] = stack[-1] if stack else -1
        if s["level"]:
            stack.append(i)
        s["anchor"] = _slug(s["heading"], taken) if s["level"] else ""
        s["end"] = out[i + 1]["start"] - 1 if i + 1 < len(out) else len(lines)
        prose = "\n".join(x for x, code in s.pop("lines") if not code)
        s["code_refs"], s["links"], s["prose"] = _CODE.findall(prose), _LINK.findall(prose), prose.strip()
    return [s for s in out if s["level"] or s["prose"]]


def sections(docs: DataFrame, *, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a section of every text; null and empty texts have none."""
    cols = ["heading", "level", "anchor", "start", "end", "parent", "code_refs", "links", "prose"]

    def run(frames):
        for f in frames:
            rows = [(d, *[s[c] for c in cols]) for d, t in zip(f["doc_id"], f["text"], strict=True) if t for s in split_sections(t)]
            yield pd.DataFrame(rows, columns=["doc_id", *cols])

    return docs.select(F.col(id_).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, SCHEMA)
