"""Cues are looked for as plain words, and found where case-insensitive patterns find them."""

import random
import re

from tidemark.llm import html_text

PATTERNS = {
    "copyright": r"©|\(c\)|copyright|all rights reserved",
    "cookie": r"\bcookies?\b|\bconsent\b|privacy",
    "subscribe": r"subscribe|newsletter|sign ?up|log ?in|sign ?in|password|e-?mail",
    "advert": r"advertis|sponsor|buy now|order now|sale\b|discount|% off",
    "reply": r"\breply\b|\bcomments?\b|\bsays:|\bwrote:|posted by|great (?:post|article)|thanks for",
    "more": r"read more|related|share|follow us|most read|see also|home|menu|skip to",
}


def test_cues_are_those_of_patterns():
    r = random.Random(4)
    words = "© (c) copyright all rights reserved cookie cookies cookiest consent consents privacy subscribe sign up signup login e-mail email sale sales wholesale"
    words += " % off reply replying comment comments says: essays: wrote: posted by great post article thanks for read more homes skip to é ß 中 _ - İ Σ"
    words = words.split()
    seen = set()
    for _ in range(20_000):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "", "_", "é", "."]) for _ in range(r.randint(1, 4)))
        text = "".join(r.choice([c, c.upper(), {"i": "İ", "s": "ſ", "k": "K"}.get(c, c), {"i": "ı"}.get(c, c)]) for c in text)
        want = [k for k, p in PATTERNS.items() if re.search(p, text, re.I)]
        assert html_text.cues(text) == want, text
        seen.update(want)
    assert seen == set(PATTERNS)


def test_a_block_is_read_once_for_its_cues(monkeypatch):
    read = []
    monkeypatch.setattr(html_text, "cues", lambda text: read.append(text) or ["more"])
    rows = html_text.features(html_text.blocks("<p>One two.</p><p>" + "word " * 40 + "</p>"))
    assert len(read) == 2
    assert ["cue=more" in x for x in rows] == [True, True] and ["short+cue=more" in x for x in rows] == [True, False]
