"""Texts with copies, edits and odd cases, and plain versions of what operators share."""

import random

ODD = [None, "", " \t\n", "one", "two words", "Ünï code  sp ace\n\n", "x" * 5000, "a " * 3000]


def documents(n=120, seed=3, odd=True) -> list[tuple]:
    """(doc_id, text) with exact copies, near copies, shared passages and odd texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgéß", k=rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    texts: list = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.35:
            parts = rng.choice(texts).split(" ")
            for _ in range(1 + len(parts) // 60):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            texts.append(" ".join(parts))
        else:
            body = rng.choices(words, k=rng.choice([3, 5, 12, 40, 120, 300]))
            if rng.random() < 0.3:
                body.insert(rng.randrange(len(body)), passage)
            texts.append(" ".join(body))
    if odd:
        texts += ODD + ODD
    return [(i * 3 + 1, text) for i, text in enumerate(texts)]


def docs_frame(spark, rows):
    """As a table with further columns whose names clash with the operators' own."""
    wide = [(i, text, "en", "src", None, 1, "x") for i, text in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, node string"
    return spark.createDataFrame(wide, schema).repartition(5)


def plain_words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def smallest_reachable(nodes, links):
    """Component ids by a walk."""
    near = {x: set() for x in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    label = {}
    for x in sorted(nodes):
        if x in label:
            continue
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in label:
                label[y] = x
                todo += near[y]
    return label
