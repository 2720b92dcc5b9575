"""What the n-gram join keeps on disk: sets once, and no table that nothing reads any more."""

import os

from corpusloom.llm import ngram_join


def test_tables_go_when_nothing_reads_them(spark, monkeypatch):
    made, left, ended = [], [], []
    table, joined = ngram_join.Workspace.table, ngram_join.join_groups

    def told(self, df, by=None):
        out = table(self, df, by)
        made.append((set(out.columns), out._corpusloom_path.removeprefix("file:")))
        return out

    def watched(rows, groups, keys, *a, **b):
        if keys == ["shingle"]:
            left.append([c for c, path in made if "kind" in c and "spot" in c and os.path.exists(path)])
        return joined(rows, groups, keys, *a, **b)

    monkeypatch.setattr(ngram_join.Workspace, "table", told)
    monkeypatch.setattr(ngram_join, "join_groups", watched)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(words[: 40 + i % 7] + [f"x{i}"])) for i in range(30)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    ended = [c for c, path in made if "pivot" in c and "spot" in c and os.path.exists(path)]
    assert left and not any(left)
    assert not ended
    assert {r.component_id for r in got.collect()} == {0}
