"""Identifier handling: split and back-quote multi-part names.

Names coming from users or job records are never spliced into SQL raw;
each part is back-quoted, with embedded back-quotes doubled.
"""

from __future__ import annotations

SESSION_CATALOG = "spark_catalog"


def quote_part(part: str) -> str:
    if part is None or part == "":
        raise ValueError("empty identifier part")
    return "`" + part.replace("`", "``") + "`"


def split_name(name: str) -> list[str]:
    """Split ``cat.db.t`` honouring back-quoted parts (``db.`a.b```)."""
    parts: list[str] = []
    buf: list[str] = []
    quoted = False
    i = 0
    while i < len(name):
        ch = name[i]
        if quoted:
            if ch == "`":
                if i + 1 < len(name) and name[i + 1] == "`":
                    buf.append("`")
                    i += 1
                else:
                    quoted = False
            else:
                buf.append(ch)
        elif ch == "`":
            quoted = True
        elif ch == ".":
            parts.append("".join(buf))
            buf = []
        else:
            buf.append(ch)
        i += 1
    if quoted:
        raise ValueError(f"unbalanced back-quote in {name!r}")
    parts.append("".join(buf))
    if any(p == "" for p in parts):
        raise ValueError(f"empty part in identifier {name!r}")
    return parts


def quote_name(name: str | list[str]) -> str:
    parts = split_name(name) if isinstance(name, str) else list(name)
    return ".".join(quote_part(p) for p in parts)


def join_name(*parts: str | None) -> str:
    """Join already-split parts (skipping ``None``) into a quoted name."""
    out: list[str] = []
    for p in parts:
        if p is None or p == "":
            continue
        out.extend(split_name(p))
    return quote_name(out)


def catalog_of(name: str, current_catalog: str = SESSION_CATALOG) -> str:
    """Catalog part of a table name: 3+ parts name it, else the current one."""
    parts = split_name(name)
    return parts[0] if len(parts) >= 3 else current_catalog


def table_part(name: str) -> str:
    return split_name(name)[-1]


def namespace_part(name: str) -> list[str]:
    return split_name(name)[:-1]
