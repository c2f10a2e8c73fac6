"""Plain-Python models the operators are compared with."""

from __future__ import annotations

import re
from collections import Counter, defaultdict


def spans(text: str) -> list[tuple[int, int, str]]:
    text = text.strip()
    for head in ("```html", "```"):
        text = text.removeprefix(head)
    text = text.removesuffix("```").strip()
    found, token, start, label = [], 0, None, None
    at = 0
    for tag in [*re.finditer(r"</?span[^>]*>", text), None]:
        token += len(text[at : tag.start() if tag else len(text)].split())
        if tag is None:
            break
        at = tag.end()
        opened = re.fullmatch(r'<span\s+class="([^"]+)">', tag.group())
        if opened:
            start, label = token, opened.group(1).lower()
        elif tag.group() == "</span>":
            if start is not None:
                found.append((start, token - 1, label))
            start = label = None
        else:
            token += len(tag.group().split())
    return found


def f1(pairs: list[tuple[str, str]]) -> tuple[float, float]:
    """Macro and weighted F1 of (prediction, reference) labels."""
    labels = {x for pair in pairs for x in pair}
    support = Counter(r for _, r in pairs)
    predicted = Counter(p for p, _ in pairs)
    hits = Counter(p for p, r in pairs if p == r)
    score = {x: 2 * hits[x] / (support[x] + predicted[x]) for x in labels}
    macro = sum(score.values()) / len(score)
    return macro, sum(score[x] * support[x] for x in labels) / len(pairs)


def lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def average_ranks(values: list[float]) -> list[float]:
    order = sorted(range(len(values)), key=lambda i: values[i])
    places = defaultdict(list)
    for place, i in enumerate(order, start=1):
        places[values[i]].append(place)
    return [sum(places[v]) / len(places[v]) for v in values]


def signed_rank(a: list[float], b: list[float]):
    d = [x - y for x, y in zip(a, b) if x != y]
    ranks = average_ranks([abs(x) for x in d])
    plus = sum(r for r, x in zip(ranks, d) if x > 0)
    minus = sum(r for r, x in zip(ranks, d) if x < 0)
    ties = sum(t**3 - t for t in Counter(abs(x) for x in d).values())
    return len(d), plus, minus, ties


def exact_signed_rank_p(statistic: float, n: int) -> float:
    """Two-sided p by listing all sign patterns."""
    low = 0
    for mask in range(2**n):
        if sum(i + 1 for i in range(n) if mask >> i & 1) <= statistic:
            low += 1
    return min(1.0, 2 * low / 2**n)


def meteor_matches(pred: list[str], ref: list[str], stem, related) -> list[tuple[int, int]]:
    """Alignment by direct search, without the stacks."""
    p, r, out = list(enumerate(pred)), list(enumerate(ref)), []
    tests = (
        lambda x, y: x == y,
        lambda x, y: stem(x) == stem(y),
        lambda x, y: x == y or y in related.get(x, ()),
    )
    for same in tests:
        for i, x in reversed(list(p)):
            for j, y in reversed(r):
                if same(x, y):
                    out.append((i, j))
                    p.remove((i, x))
                    r.remove((j, y))
                    break
    return sorted(out)
