"""Text forms of search and graph results of bounded size, for people to read."""

from __future__ import annotations

from folioscope.functions import text as T

STATS = {"nodes": "pages", "links": "links", "distinct_edges": "different links", "resolved": "to pages", "dangling": "to no page", "entities": "entities", "entity_mentions": "mentions", "relations": "relations"}


def some(n: int, what: str, ending: str = "s") -> str:
    return f"{n} {what}" + ("" if n == 1 else ending)


def kind(m: T.Matcher) -> str:
    """How a query is matched."""
    if m.tokens:
        return f"all of {len(m.tokens)} words in any order, the phrase first: {', '.join(m.tokens)}"
    return ("regular expression" if m.regex else "literal") + (", any case" if "i" in m.flags else ", case as given")


def search_head(m: T.Matcher) -> str:
    return f'Search for "{m.query}" ({kind(m)})'


def search_summary(m: T.Matcher, found: list[tuple[str, str | None, list[str]]], head: int) -> str:
    """Pages (path, area, excerpts) in order; one more than ``head`` says that there are others."""
    if not found:
        return f"{search_head(m)}\nno page matches\n"
    shown = found[:head]
    matches = sum(len(bodies) for _, _, bodies in shown)
    out = [search_head(m), f"{some(len(shown), 'page')}, {some(matches, 'match', 'es')}"]
    for path, area, bodies in shown:
        out += ["", f"## {path}" + (f" ({area})" if area else "")]
        out += [f"> {line}" for body in bodies for line in body.rstrip("\n").split("\n")]
    out += ["", f"more than {head} pages match: raise --head, or narrow the query or its --category" if len(found) > head else "all matching pages are shown"]
    return "\n".join(out) + "\n"


def search_content(m: T.Matcher, rows: list[tuple[str, int, str]], partial: bool, head: int) -> str:
    """Lines (path, number, line) by page and number, under the page's name."""
    out = [search_head(m)] + ([] if rows else ["no line matches"])
    at = None
    for path, number, line in rows:
        if path != at:
            out += ["", path]
        at = path
        out.append(f"{path}:{number}: {line}")
    return "\n".join(out + ([f"\nmore than {head} pages match"] if partial else [])) + "\n"


def step(source: str, target: str, label: str | None) -> str:
    return f"{source} -{f'[{label}]' if label else ''}-> {target}"


def stats(row: dict) -> str:
    return "\n".join(f"{name}: {row[key]}" for key, name in STATS.items() if key in row) + "\n"


def neighbors(root: str, depth: int, direction: str, rows: list[dict]) -> str:
    out = [f"Around {root}, {some(depth, 'step')}, direction {direction}"]
    out += [f"{r['depth']} {r['direction']}: {step(r['source'], r['target'], r['link_text'])}" + ("" if r["resolved"] else " (no such page)") for r in rows]
    return "\n".join([*out, some(len(rows), "link") if rows else "no links"]) + "\n"


def path(source: str, target: str, steps: list[dict] | None) -> str:
    head = f"From {source} to {target}: "
    if steps is None:
        return head + "no way over links\n"
    if not steps:
        return head + "the same page\n"
    return "\n".join([head + some(len(steps), "step"), *(f"{k}. {step(s['source'], s['target'], s['link_text'])}" for k, s in enumerate(steps, 1))]) + "\n"


def entities(rows: list[dict]) -> str:
    out = [f"{r['canonical_name']} ({r['entity_type']}): {some(r['mentions'], 'mention')}, confidence {r['confidence']:.2f}, {r['id']}" for r in rows]
    return "\n".join(out or ["no entities"]) + "\n"


def entity_neighbors(entity: str, rows: list[dict]) -> str:
    out = [f"Around {entity}"]
    for r in rows:
        out.append(f"{r['direction']} {r['predicate']}: {r['neighbor_name']} ({r['neighbor_type']}), confidence {r['confidence']:.2f}")
        out += [f"  in {chunk}" for chunk in r["evidence"]]
    return "\n".join(out if rows else [*out, "no relations"]) + "\n"
