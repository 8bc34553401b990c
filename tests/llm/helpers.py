import random

SYLLABLES = "ba de ki lo mu na pe ri so tu va xe".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def rows_of(texts, source="s"):
    return [(i, t, "en", source if isinstance(source, str) else source[i], None if t is None else len(t)) for i, t in enumerate(texts)]
