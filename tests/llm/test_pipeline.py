import os
import random
from collections import Counter

import corpus_pipeline
import pytest
from surfmesh.llm import mixing, sharding
from surfmesh.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(16)


def text(n=80):
    sounds = "th er on an re he in ed nd ha at en".split()
    return " ".join("".join(rng.choices(sounds, k=rng.randint(2, 5))) for _ in range(n))


def written(spark, folder, rows, labels, items):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def similar(a, b):
    """Whether the sets of five-word shingles of two texts have a Jaccard similarity of 0.8 and more."""
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((x or "").lower().split() for x in (a, b))]
    if not grams[0] or not grams[1]:
        return not grams[0] and not grams[1]
    return len(grams[0] & grams[1]) >= 0.8 * len(grams[0] | grams[1])


def one_of_each(rows):
    """The rows that stay: of each chain of similar texts the least id, null last."""
    left, stay = list(rows), []
    while left:
        group, left = [left[0]], left[1:]
        for r in group:  # grows while it is read
            near = [x for x in left if similar(r[1], x[1])]
            group += near
            left = [x for x in left if x not in near]
        stay.append(min(group, key=lambda r: (r[0] is None, r[0] or 0)))
    return stay


def near(source, changed):
    words = source.split()
    for k in changed:
        words[k] = "changed"
    return " ".join(words)


def test_stages_end_to_end(spark, tmp_path):
    """Each stage against brute force on what the one before kept, and the order of the mix and the shards of the last."""
    item = text(30)
    rows = [(k, text(), "hot" if k % 3 == 0 else f"s{k % 4}") for k in range(300)]
    rows += [(300 + k, text(40) + " zonkhead zonkhead zonkhead zonkhead " + text(40), "s1") for k in range(60)]
    rows += [(400, rows[1][1], "s2"), (401, rows[1][1], "s2"), (402, text() + " " + item, "s0"), (403, None, None), (404, "", None), (405, item, "hot")]
    # Near copies: one word of 80 changes 5 of 76 shingles; two far apart 10; four 20, which is too many.
    rows += [(410, near(rows[2][1], [20]), "s2"), (411, near(rows[2][1], [20, 60]), "s2"), (412, near(rows[5][1], [10, 30, 50, 70]), "hot")]
    d = written(spark, tmp_path / "t", rows, [(i, 1, int(300 <= i < 360)) for i, *_ in rows if i < 360], [(0, item)])
    got = corpus_pipeline.run(spark, d)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "n_bytes", "mix_part", "mix_row"]
    found = got.collect()
    clean = [r for r in rows if not 300 <= r[0] < 360]
    kept = [r for r in one_of_each(clean) if item not in (r[1] or "")]
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in kept)
    assert {410, 411}.isdisjoint(r.doc_id for r in found) and 412 in {r.doc_id for r in found}
    texts = dict((i, t) for i, t, _ in rows)
    assert all(r.text == texts[r.doc_id] and r.n_bytes == len((r.text or "").encode()) and r.shard == "" for r in found)
    # The rows come in the order of the mix.
    last = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in kept], SCHEMA)
    place = {r.doc_id: r._position for r in mixing.mixed(last).collect()}
    order = [place[r.doc_id] for r in sorted(found, key=lambda r: (r.mix_part, r.mix_row))]
    assert order == sorted(place.values())
    files = [r[0] for r in got.selectExpr("input_file_name()").limit(1).collect()]
    # Nothing but the last stage's folder is left.
    left = [f for f in os.listdir(os.path.dirname(os.path.dirname(files[0].removeprefix("file:")))) if not f.startswith(".")]
    assert left == ["4-sharding"]


def test_shards_of_the_last_stage_fit(spark, monkeypatch):
    rows = [(k, text(30), "en", f"s{k % 3}", 0) for k in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(sharding.sharded, "__kwdefaults__", {**sharding.sharded.__kwdefaults__, "limit": 3000})
    found = corpus_pipeline.shard(spark, docs, "").collect()
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.n_bytes
    assert len(found) == 200 and len(sizes) > 5 and max(sizes.values()) <= 3000
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_empty_tables(spark, tmp_path):
    d = written(spark, tmp_path / "t", [], [], [])
    got = corpus_pipeline.run(spark, d)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "n_bytes", "mix_part", "mix_row"] and got.count() == 0


def test_without_labels_and_items_only_copies_go(spark, tmp_path):
    rows = [(k, text(20), None) for k in range(20)] + [(None, text(20), "a"), (3, None, "b"), (3, None, "b"), (50, "", "b")]
    d = written(spark, tmp_path / "t", rows, [], [])
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, d).collect()) == sorted(map(str, [*range(20), None, 3]))


@pytest.mark.parametrize("k", range(5))
def test_stages_stand_clashing_names(spark, tmp_path, k):
    """Names that the operators use inside and maps, in any stage; all but the last return just these columns."""
    d = written(spark, tmp_path / "t", [(1, "a b", "s")], [(j, 1, 0) for j in range(12)], [(0, text(20))])
    clash = ("_slot", "_Block", "_position", "shard", "N_BYTES", "_doc", "_h", "_id", "_row", "_text", "root", "sd", "_g", "_run", "_bytes")
    docs = spark.createDataFrame([(j, text(20), "en", f"s{j % 2}", 5, *[j] * len(clash), {"k": j}) for j in range(12)], SCHEMA + "".join(f", `{c}` long" for c in clash) + ", tags map<string,int>")
    out = corpus_pipeline.STAGES[k][1](spark, docs, d)
    out.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    gone = ("shard", "N_BYTES", "_bytes") if k == 4 else ()
    assert back.columns == [c for c in docs.columns if c not in gone] + (["shard", "n_bytes", "mix_part", "mix_row"] if k == 4 else [])
    assert all(r["_slot"] == r.doc_id and r.tags == {"k": r.doc_id} for r in back.collect())
    assert back.count() == 12


def test_stages_are_those_that_were_dealt():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing_to_target_weights", "sharding"]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            @staticmethod
                            def isDefined():
                                return False

                        return Option

                return Inner

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        shared_dir(Session)
