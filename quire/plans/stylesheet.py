"""The style sheet that normalized books share: a rule for each role, made from this table."""

from __future__ import annotations

BASE = {
    "html, body": "margin: 0; padding: 0",
    "body": "margin: 0 4%; line-height: 1.35",
    "p": "margin: 0; text-indent: 1.2em",
    "h1, h2, h3, h4, h5, h6": "margin: 1.5em 0 1em; font-weight: bold; line-height: 1.2; text-align: center",
    "ol, ul": "margin: 1em 0 1em 1.6em; padding: 0",
    "a": "color: inherit",
    "em, i": "font-style: italic",
    "strong, b": "font-weight: bold",
    "sup, sub": "font-size: 75%; line-height: 0",
    "img, svg": "max-width: 100%",
}
FLUSH, MIDDLE, APART = "text-indent: 0", "text-align: center; text-indent: 0", "margin: 1em 0"
ROLES = {
    "blockquote": f"{APART}; padding-left: 1.6em", "body": "text-indent: 1.2em", "caption": f"{MIDDLE}; font-size: 90%", "centered": MIDDLE, "chapter": "margin-top: 3em", "dedication": f"{MIDDLE}; font-style: italic",
    "extract": f"{APART}; margin-left: 1.6em; margin-right: 1.6em", "first": FLUSH, "footnote": "font-size: 85%", "front": "margin-top: 2em", "front-body": "margin-bottom: 0.5em; text-indent: 0", "front-list-item": f"{FLUSH}; margin-bottom: 0.3em",
    "front-section": f"{MIDDLE}; letter-spacing: 0.05em", "hanging": "margin-left: 1.6em; text-indent: -1.6em", "image": f"{APART}; {MIDDLE}", "letter": f"{APART}; padding: 0 1.6em", "letter-attribution": "text-align: right; text-indent: 0", "letter-body": "text-indent: 1.2em",
    "letter-first": FLUSH, "letter-opener": f"{FLUSH}; margin-bottom: 0.6em", "list": APART, "metadata-line": f"{FLUSH}; font-size: 90%", "metadata-page": APART, "metadata-title": f"{FLUSH}; font-weight: bold",
    "part": "margin-top: 4em; letter-spacing: 0.05em", "poetry": "margin-left: 1.6em; text-indent: 0", "right": "text-align: right; text-indent: 0", "scene-break": f"{APART}; {MIDDLE}", "section": "margin-top: 2em", "title-author": f"{MIDDLE}; font-size: 120%",
    "title-credit": MIDDLE, "title-credit-label": f"{MIDDLE}; font-style: italic", "title-main": "font-size: 180%; margin-top: 3em", "title-page": "text-align: center", "title-publisher": f"{MIDDLE}; margin-top: 3em",
    "toc": APART, "toc-chapter": f"{FLUSH}; margin-left: 1.2em", "toc-entry": FLUSH, "toc-heading": "margin-bottom: 1em", "toc-part": f"{FLUSH}; font-weight: bold; margin-top: 0.8em",
    "overline": "text-decoration: overline", "smallcaps": "font-variant: small-caps", "strike": "text-decoration: line-through", "underline": "text-decoration: underline",
}


def text() -> str:
    rules = {**BASE, **{f".eo-{name}": body for name, body in ROLES.items()}}
    return "".join(f"{selector} {{ {body}; }}\n" for selector, body in rules.items())
