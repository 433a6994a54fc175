"""What several tests of this folder use."""

from __future__ import annotations

import random

from gleaner.llm import texts


def prose(rng: random.Random, words: int) -> str:
    """Words of a few syllables, in sentences of one line each."""
    made = ["".join(rng.choices(["ka", "lo", "mi", "tu", "re", "sen", "dor", "é", "ü"], k=rng.randint(1, 3))) for _ in range(words)]
    return "".join(w + ("\n" if i % 11 == 10 else " ") for i, w in enumerate(made)).strip()


def plain_set(text):
    return set(texts.shingle_hashes(text or "", 5))


def plain_kept(rows, bar=0.8):
    """The smallest id of every group, all texts compared with all."""
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if group[i] != group[j] and (sets[i] == sets[j] or both >= bar * len(sets[i] | sets[j])):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {min(r[0] for r, g in zip(rows, group) if g == x) for x in set(group)}
