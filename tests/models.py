"""Plain-Python models of order-dependent rules, one step at a time, to compare closed forms with."""

import math
import re

from linkweave import constants as C


def units(text):
    return len(text.encode("utf-16-le")) // 2


def words_of(text):
    out = []
    for w in re.split(r"[\s/-_.,!?():]+", text.lower()):
        if units(w) >= C.KEYWORD_MIN_LENGTH and w not in C.STOP_WORDS and not w.isdigit():
            out.append(w)
    return out


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    a, b = (re.sub(r"[^\w]|_", " ", s.lower()).strip(" ") for s in (a, b))
    if not a or not b:
        return 0
    return math.floor(200 * common(a, b) / (len(a) + len(b)) + 0.5)


def best_matches(text, tags, lemmas, limit=6):
    """tags in rank order; lemmas: dict word -> set of lemmas."""

    def forms(w):
        return {w.lower()} | lemmas.get(w.lower(), set())

    scores, types = {}, {}

    def add(tag, points, kind):
        scores[tag] = scores.get(tag, 0) + points
        types.setdefault(tag, set()).add(kind)

    for word in words_of(text):
        for tag in tags:
            if word == tag:
                add(tag, 15, "perfect")
            elif forms(word) & forms(tag):
                add(tag, 12, "grammatical-variation")
            elif word in tag:
                add(tag, 8, "keyword-in-tag")
            elif units(tag) > 2 and tag in word:
                add(tag, 5, "tag-in-keyword")
        for tag in tags:
            if tag not in scores:
                r = ratio(word, tag)
                if r >= 80:
                    add(tag, r / 10, "fuzzy")
    best = sorted(scores.items(), key=lambda kv: -kv[1])  # stable: first inserted wins a tie
    return [(t, s, types[t]) for t, s in best[:limit]]


def save_in_order(stored, requests):
    """stored: url -> dict(user, content); requests: ordered (url, user, content, ok)."""
    table = {u: dict(r) for u, r in stored.items()}
    for url, user, content, ok in requests:
        row = table.get(url)
        if row is not None and row["user"] == user:
            continue
        if not ok:
            continue
        if row is None:
            table[url] = {"user": user, "content": content, "first": content}
        else:
            row["content"] = content
    return table


def slice_js(items, end):
    return items[:end] if end >= 0 else items[: max(0, len(items) + end)]
