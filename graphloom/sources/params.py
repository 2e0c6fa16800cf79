"""Parameter files: one case on each line."""

from __future__ import annotations

from datetime import UTC, date, datetime

#: Name and type of each query's parameters. Values with spaces need another separator than a space.
PARAMETERS: dict[str, tuple[tuple[str, str], ...]] = {
    "bfs": (("person", "long"),),
    "page_rank": (("iterations", "long"), ("damping", "double")),
    "khops": (("person", "long"),),
    "khop_any_label": (("label", "string"), ("vid", "long"), ("k", "long")),
    "ic1": (("person", "long"), ("first_name", "string")),
    "ic2": (("person", "long"), ("max_date", "ms")),
    "ic5": (("person", "long"), ("min_date", "ms")),
    "ic9": (("person", "long"), ("max_date", "ms")),
    "ic10": (("person", "long"), ("month", "long")),
    "ic13": (("a", "long"), ("b", "long")),
    "bi2": (("date", "date"), ("tagclass", "string")),
    "bi3": (("tagclass", "string"), ("country", "string")),
    "bi10": (("person", "long"), ("country", "string"), ("tagclass", "string")),
    "bi12": (("date", "date"), ("threshold", "long"), ("languages", "list")),
    "bi16": (("tag_a", "long"), ("day_a", "date"), ("tag_b", "long"), ("day_b", "date")),
    "bi19": (("city1", "long"), ("city2", "long")),
}


#: Whether a query's file begins with a header, and what parts its fields; (False, " ") for every other query.
FORMATS: dict[str, tuple[bool, str]] = dict.fromkeys(("ic2", "ic9", "ic10", "bi2", "bi12", "bi19"), (True, "|"))


def split_str(text: str, sep: str) -> list[str]:
    """The fields of a line; runs of spaces part fields once, any other separator each time."""
    return text.split() if sep == " " else text.split(sep)


def parse_value(text: str, kind: str) -> object:
    if kind == "long":
        return int(text)
    if kind == "double":
        return float(text)
    if kind == "list":
        return text.split(";")
    if kind == "date":
        return date.fromisoformat(text[:10]).isoformat()
    if kind == "ms":  # epoch milliseconds or a date
        return datetime.fromtimestamp(int(text) / 1000, UTC).date().isoformat() if text.lstrip("-").isdigit() else parse_value(text, "date")
    return text


def parse_case(query: str, line: str, sep: str | None = None) -> dict[str, object]:
    """Keyword arguments of one line; a field too few or too many is an error."""
    names = PARAMETERS[query]
    fields = split_str(line, sep or FORMATS.get(query, (False, " "))[1])
    if len(fields) != len(names):
        raise ValueError(f"{query} needs {len(names)} values: {line!r}")
    return {n: parse_value(f.strip(), k) for (n, k), f in zip(names, fields, strict=True)}


def cases(query: str, lines: list[str], limit: int | None = None, header: bool | None = None, sep: str | None = None) -> list[dict[str, object]]:
    """All cases, or the first ``limit``; ``header`` and ``sep`` stand in for the query's own format. Empty lines are passed by."""
    full = [x for x in lines if x.strip()]
    skip = FORMATS.get(query, (False, " "))[0] if header is None else header
    return [parse_case(query, line, sep) for line in full[skip:][:limit]]
