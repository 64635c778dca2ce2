"""Connected components against a search, and how many rows their joins make."""

import random

from wayloom.llm.components import components


def test_rows_of_joins(spark, monkeypatch):
    random.seed(4)
    names = random.sample(range(-10_000, 10_000), 140)
    edges = [(names[i], names[j]) for i in range(40) for j in range(i)]
    edges += [(names[i], names[i + 1]) for i in range(40, 100)] + [(names[102], names[102]), (names[103], names[104]), (names[104], names[103])]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    frame, made = spark.createDataFrame(edges, "a long, b long"), []
    kind = type(frame)

    def counted(self, *more, join=kind.join, **named):
        out = join(self, *more, **named)
        made.append(out.count())
        return out

    monkeypatch.setattr(kind, "join", counted)
    assert sorted(map(tuple, components(frame).collect())) == sorted(least.items())
    assert sum(made) <= 4 * len(edges)
    assert components(frame.limit(0)).count() == 0
