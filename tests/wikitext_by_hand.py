"""Infobox and plain text of a page, walked brace by brace: what the SQL functions are compared with."""

import re

TELEVISION = r"(?i)\{\{\s*infobox\s+television\b"
PARAMETER = re.compile(r"\|\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$")
BULLET = re.compile(r"^[^\S\n]*\*.*$", re.M)
BRACES = re.compile(r"\{\{|\}\}")
#: Rewrites of an infobox value, in order, before its trimming.
VALUE_REWRITES = [
    (r"(?is)<ref[^>]*>.*?</ref>", " "),
    (r"(?i)<ref[^>]*/>", " "),
    (r"(?i)\{\{\s*(?:plainlist|unbulleted list|ubl|hlist|idp|efn)\s*\|", ""),
    (r"\{\{|\}\}", " "),
    (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", r"\1"),
    (r"<[^>]+>", " "),
    (r"(?m)^[*#:;•]+\s*", ""),
    (r"[\r\n]+", ", "),
    (r"\s+", " "),
]
#: Rewrites of page text around the removal of templates, in order.
BEFORE_TEMPLATES = [(r"(?s)<!--.*?-->", " "), *VALUE_REWRITES[:2]]
AFTER_TEMPLATES = [
    (r"''+([^'].*?)''+", r"\1"),
    (r"\[\[(?:File|Image):[^\]]+\]\]", " "),
    VALUE_REWRITES[4],
    (r"https?://\S+", " "),
    (r"={2,}\s*(.*?)\s*={2,}", r" \1 "),
    (r"<[^>]+>", " "),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
]


def rewritten(text: str, rewrites: list[tuple[str, str]]) -> str:
    for pattern, by in rewrites:
        text = re.sub(pattern, by, text)
    return text


def clean_value(value: str) -> str:
    items = BULLET.findall(value) if "{{Collapsible list" in value else []
    return rewritten("\n".join(items) or value, VALUE_REWRITES).strip(" ,;")


def block_end(text: str, start: int) -> int:
    """Where the template that starts here ends: after its closing braces, or at the text's end."""
    depth = 0
    for m in BRACES.finditer(text, start):
        depth += 1 if m[0] == "{{" else -1
        if not depth:
            return m.end()
    return len(text)


def infobox_of(text: str | None) -> dict[str, str]:
    """Parameters of the first television infobox, keys in lower case; later ones win unless they are empty."""
    m = re.search(TELEVISION, text or "")
    if not m:
        return {}
    lines = text[m.start() : block_end(text, m.start())].splitlines()[1:]
    if lines and lines[-1].strip().startswith("}}"):
        lines.pop()
    found: list[tuple[str, list[str]]] = []
    for line in lines:
        if p := PARAMETER.match(line):
            found.append((p[1].lower(), [p[2]]))
        elif found:
            found[-1][1].append(line)
    values = ((k, "\n".join(v).strip()) for k, v in found)
    return {"_infobox_type": "television"} | {k: clean_value(v) for k, v in values if v}


def without_infobox(text: str) -> str:
    m = re.search(r"(?i)\{\{\s*infobox\b", text)
    if not m:
        return text
    return text[: m.start()] + text[block_end(text, m.start()) :].lstrip(" \t\r\n")


def without_templates(text: str) -> str:
    """Text outside {{ }}; closing braces without an opening stay, an opening without a closing takes the rest."""
    out, depth, at = [], 0, 0
    for m in BRACES.finditer(text):
        if not depth and m[0] == "}}":
            continue
        if not depth:
            out.append(text[at : m.start()])
        depth += 1 if m[0] == "{{" else -1
        at = m.end()
    return "".join(out) + ("" if depth else text[at:])


def plain_text_of(text: str | None) -> str:
    text = without_templates(rewritten(without_infobox(text or ""), BEFORE_TEMPLATES))
    return rewritten(text, AFTER_TEMPLATES).strip()
