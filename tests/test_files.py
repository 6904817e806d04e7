"""File sources cut into byte ranges far smaller than a session, an item or a dialogue."""

import json
import random
import zipfile

import pytest
from compare import check, duck

import __spark_entry__ as entry
from colloquy.sources import dialogues as D, ranges as Ra, readers as R, writers as Wr

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_ranges(spark):
    """Ranges of 2,000 bytes, whatever the file."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_numbered_across_ranges_and_files(small_ranges, tmp_path):
    texts = {"a.txt": ["", "x"] + [f"line {i} é" for i in range(3000)], "b.txt": ["only"], "c.txt": ["é" * 7000, "", "end"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name != "b.txt" else ""), encoding="utf-8")
    rows = Ra.numbered_lines(small_ranges, str(tmp_path)).collect()
    assert len({(r.source, r.block) for r in rows}) > 10
    for name, lines in texts.items():
        assert [r.value for r in sorted((r for r in rows if r.source.endswith(name)), key=lambda r: r.n)] == lines
    across = {r.n: r.value for r in Ra.numbered_lines(small_ranges, str(tmp_path), across=True).collect()}
    assert [across[k] for k in range(len(across))] == [x for name in sorted(texts) for x in texts[name]]


def wild(rng):
    """Text full of what could be taken for structure."""
    return "".join(rng.choices(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "\n", "\t", "\\\"}"], k=rng.randint(0, 60)))


@pytest.mark.parametrize("indent,broadcast", [(None, 10_000), (2, 0)])
def test_sessions_in_ranges(small_ranges, tmp_path, monkeypatch, indent, broadcast):
    monkeypatch.setattr(Ra, "BROADCAST_BLOCKS", broadcast)
    rng = random.Random(indent)
    sessions = {}
    for i in range(60):
        turns = [{"role": "usr", "content": wild(rng), "dialog_act": [["Inform", wild(rng), "s", wild(rng)]] * rng.randint(0, 3), "sys_state": {"d": {"k": wild(rng)}}} for _ in range(rng.randint(0, 6))]
        sessions[f"{i}{wild(rng)}"] = {"type": wild(rng), "messages": turns}
    sessions["last"] = {}
    text = json.dumps(sessions, ensure_ascii=False, indent=indent) + ("\n" if indent else "")
    (tmp_path / "s.json").write_text(text, encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "z.json.zip", "w") as z:
        z.writestr("s.json", text)
    for name in ("s.json", "z.json.zip"):
        got = {r.session_id: r for r in R.read_sessions(small_ranges, str(tmp_path / name), "train").collect()}
        assert set(got) == set(sessions)
        for k, s in sessions.items():
            want = [(m["content"], [tuple(a) for a in m["dialog_act"]], m["sys_state"]) for m in s.get("messages", [])]
            assert [(m.content, [tuple(a) for a in m.acts], m.sys_state) for m in got[k].messages or []] == want and got[k].goal_type == s.get("type")


def test_entities_in_ranges(small_ranges, tmp_path):
    rng = random.Random(4)
    rows = [(f"n{i % 50}", {"价格": i, "near": [wild(rng), "x"], "more": {"deep": {"er": wild(rng)}}}) for i in range(80)]
    want = dict(rows)
    (tmp_path / "pairs.json").write_text(json.dumps(rows, ensure_ascii=False, indent=1), encoding="utf-8")
    (tmp_path / "objects.json").write_text(json.dumps([{"名称": n, **a} for n, a in rows], ensure_ascii=False), encoding="utf-8")
    assert {r.name: json.loads(r.attrs) for r in R.read_entities(small_ranges, str(tmp_path / "pairs.json")).collect()} == want
    assert {r.name: json.loads(r.attrs) for r in R.read_entities(small_ranges, str(tmp_path / "objects.json")).collect()} == {n: {"名称": n, **a} for n, a in want.items()}
    for empty in ("[]", "{}", ""):
        (tmp_path / "empty.json").write_text(empty)
        assert not R.read_entities(small_ranges, str(tmp_path / "empty.json")).collect()


def test_written_documents_are_json(spark, tmp_path):
    df = spark.createDataFrame([(i, f'k"{i}', i % 3) for i in range(50)], "id long, k string, v int")
    Wr.write_json_document(df.select("id", Wr.json_member("k", "v").alias("e")), str(tmp_path / "d"), "e", ["id"], parts=4)
    read = {}
    for f in (tmp_path / "d").glob("part=*/*.txt"):
        read |= json.loads(f.read_text())
    assert read == {f'k"{i}': i % 3 for i in range(50)}


@pytest.mark.parametrize("name", ["session_file_acts", "entity_file", "vocabulary_file", "vector_file", "dialogue_file_lines", "dialogue_file_totals"])
def test_queries_in_ranges(spark, name):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        message, ok = check(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ok, message


def test_dialogue_memory_over_ranges(small_ranges, tmp_path):
    text = "\n\n".join("\n".join(["1 resto R_cuisine thai"] + [f"{i + 2} hello{i} there\thi resto" for i in range(40)]) for _ in range(5)) + "\n"
    (tmp_path / "d.txt").write_text(text)
    lines = D.read_numbered_dialogues(small_ranges, str(tmp_path / "d.txt"))
    t = D.dialogue_totals(lines).first()
    assert (t.dialogues, t.user_turns, t.bot_turns, t.kb_lines) == (5, 200, 200, 5)
    rows = D.memory_rows(lines).filter("block = 0 and word like 'hello%'").collect()
    assert len(rows) == 200 and all(r.row[2] == f"turn{int(r.word[5:]) + 1}" for r in rows)
