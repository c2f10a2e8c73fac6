"""ROUGE and METEOR row scores.

Clipped n-gram counts, longest common subsequences and word alignment are
per-row loops no built-in expresses in linear time, so they run as Arrow
batched functions. They are row-local: no shuffle, any row count.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .text import col

ROUGE_TYPE = "struct<rouge1:double,rouge2:double,rougeL:double>"
_ROUGE_WORD = re.compile(r"[a-z0-9]+")


def f_measure(shared: float, predicted: float, expected: float) -> float:
    if not shared or not predicted or not expected:
        return 0.0
    p, r = shared / predicted, shared / expected
    return 2 * p * r / (p + r)


def ngram_f(pred: list, ref: list) -> float:
    """F-measure of the multiset overlap."""
    shared = sum((Counter(pred) & Counter(ref)).values())
    return f_measure(shared, len(pred), len(ref))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine-word row at a time.

    Bit-vector form of the dynamic program (Crochemore et al. 2001, Hyyrö
    2004): a Python integer holds a whole row, so the cost is n*m/64.
    """
    if len(a) > len(b):
        a, b = b, a
    where: dict = defaultdict(int)
    for i, token in enumerate(a):
        where[token] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_row(pred: str, ref: str, want: frozenset[str]) -> dict[str, float | None]:
    p, r = _ROUGE_WORD.findall(pred.lower()), _ROUGE_WORD.findall(ref.lower())
    return {
        "rouge1": ngram_f(p, r) if "rouge1" in want else None,
        "rouge2": ngram_f(list(zip(p, p[1:])), list(zip(r, r[1:])))
        if "rouge2" in want
        else None,
        "rougeL": f_measure(lcs_length(p, r), len(p), len(r)) if "rougeL" in want else None,
    }


def rouge(
    pred: Column | str,
    ref: Column | str,
    variants: tuple[str, ...] = ("rouge1", "rouge2", "rougeL"),
    on_error: str = "null",
) -> Column:
    """ROUGE F-measures as one struct; texts are tokenized once for all.

    A null text has no score: null by default, 0.0 with ``on_error="zero"``.
    """
    want = frozenset(variants)
    failed = {v: (0.0 if on_error == "zero" else None) for v in variants}

    @F.arrow_udf(ROUGE_TYPE)
    def score(p: pa.Array, r: pa.Array) -> pa.Array:
        # One pair at a time: a batch of long texts is not copied as a whole.
        rows = [
            rouge_row(a.as_py(), b.as_py(), want) if a.is_valid and b.is_valid else failed
            for a, b in zip(p, r)
        ]
        fields = ("rouge1", "rouge2", "rougeL")
        return pa.StructArray.from_arrays(
            [pa.array([row.get(f) for row in rows], pa.float64()) for f in fields], list(fields)
        )

    return score(col(pred), col(ref))


def rouge_n(pred: Column | str, ref: Column | str, n: int, on_error: str = "null") -> Column:
    return rouge(pred, ref, (f"rouge{n}",), on_error)[f"rouge{n}"]


def rouge_l(pred: Column | str, ref: Column | str, on_error: str = "null") -> Column:
    return rouge(pred, ref, ("rougeL",), on_error)["rougeL"]


# --- METEOR ----------------------------------------------------------------

# Clitics and the parts of fused words are their own tokens; abbreviations with
# inner periods and hyphenated words stay whole; every other mark is a token.
# The fused words of the Treebank tokenisation.
_METEOR_WORD = re.compile(
    r"``|''|\b(?:can(?=not\b)|gim(?=me\b)|gon(?=na\b)|got(?=ta\b)|lem(?=me\b)|wan(?=na\b))"
    r"|\bd(?='ye\b)|'ye\b|\bmore(?='n\b)|'n\b|(?<!\w)'t(?=(?:is|was)\b)"
    r"|\w+(?=n't\b)|n't\b|'(?:s|re|ve|ll|d|m)\b"
    r"|\d+(?:[.,:]\d+)+|(?:\w\.){2,}|\w+(?:-\w+)*|\.{3}|[^\w\s]"
)


# A double quote opens at the start and after a space or a bracket, else it closes.
_OPENING = re.compile(r'(^|[\s(\[{<])"')


def meteor_tokens(text: str) -> list[str]:
    quoted = _OPENING.sub(r"\1``", text.lower()).replace('"', "''")
    return _METEOR_WORD.findall(quoted)


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences (m in Porter 1980)."""
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", _shape(stem))))


def _shape(word: str) -> str:
    marks: list[str] = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and marks[-1] == "c")
        marks.append("v" if vowel else "c")
    return "".join(marks)


def _short_end(stem: str) -> bool:
    """consonant-vowel-consonant ending whose last letter is not w, x or y."""
    shape = _shape(stem)
    return (shape.endswith("cvc") and stem[-1] not in "wxy") or shape == "vc"


# Words the stemmer does not take apart.
_IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffix rules of Porter (1980), steps 2 to 4, with the later
# published additions "bli", "fulli" and "logi".
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _replace_longest(word: str, rules, min_measure: int) -> str:
    hit = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if hit is None:
        return word
    stem = word[: len(word) - len(hit[0])]
    if hit[0] == "ion" and not stem.endswith(("s", "t")):
        return word
    return stem + hit[1] if _measure(stem) > min_measure else word


# Stems already found in this worker; emptied when it grows past the limit.
_STEMS: dict[str, str] = {}
_STEM_LIMIT = 200_000


def porter_stem(word: str) -> str:
    """Porter stem of a lower-cased word, remembered per worker."""
    stem = _STEMS.get(word)
    if stem is None:
        if len(_STEMS) >= _STEM_LIMIT:
            _STEMS.clear()
        stem = _STEMS[word] = _stem(word)
    return stem


def _stem(word: str) -> str:
    """Porter (1980) with the common extensions.

    The extensions are the irregular words above and a gentler treatment of
    short words in "-ies", "-ied" and "-y".
    """
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s)), "")
        stem = w[: len(w) - len(cut)]
        if cut and "v" in _shape(stem):
            w = stem
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c":
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    if w.endswith("logi"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        w = _replace_longest(w, _STEP2, 0)
    w = _replace_longest(w, _STEP3, 0)
    w = _replace_longest(w, [(s, "") for s in _STEP4], 1)
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def align(pred: list[str], ref: list[str], stem, related) -> list[tuple[int, int]]:
    """One-to-one word matches: equal words, then equal stems, then synonyms.

    Each stage walks the unmatched prediction words from the last to the first
    and takes the last unmatched reference word that fits. Keeping reference
    positions on one stack per word makes a stage linear.
    """
    matches: list[tuple[int, int]] = []
    # Unmatched (position, key) of both sides.
    left, right = list(enumerate(pred)), list(enumerate(ref))

    def stage(left, right, choices):
        stacks: dict[str, list[int]] = defaultdict(list)
        for j, key in right:
            stacks[key].append(j)
        used, kept = set(), []
        for i, key in reversed(left):
            keys = [k for k in choices(key) if stacks.get(k)] if choices else (
                [key] if stacks.get(key) else []
            )
            if not keys:
                kept.append(i)
                continue
            j = stacks[keys[0] if len(keys) == 1 else max(keys, key=lambda k: stacks[k][-1])].pop()
            matches.append((i, j))
            used.add(j)
        kept.reverse()
        return kept, [j for j, _ in right if j not in used]

    free_p, free_r = stage(left, right, None)
    if free_p and free_r:
        free_p, free_r = stage(
            [(i, stem(pred[i])) for i in free_p], [(j, stem(ref[j])) for j in free_r], None
        )
    if related and free_p and free_r:
        stage(
            [(i, pred[i]) for i in free_p], [(j, ref[j]) for j in free_r],
            lambda w: {w, *related.get(w, ())},
        )
    return sorted(matches)


def meteor_row(
    pred: str, ref: str, related, alpha=0.9, beta=3.0, gamma=0.5, stem=porter_stem,
    tokens=meteor_tokens,
) -> float:
    p, r = tokens(pred), tokens(ref)
    matches = align(p, r, stem, related)
    m = len(matches)
    if not m:
        return 0.0
    breaks = sum(
        1 for a, b in zip(matches, matches[1:]) if (a[0] + 1, a[1] + 1) != (b[0], b[1])
    )
    precision, recall = m / len(p), m / len(r)
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    return mean * (1 - gamma * ((breaks + 1) / m) ** beta)
