import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrun.llm import chat
from millrun.llm.queries import op10_chat

SCHEMA = "conv_id long, turn long, role string, text string, c string, seq int, window string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def by_conv(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in out.items()}


def check_digest(rows, got):
    want = {}
    for conv, turns in by_conv(rows).items():
        lines = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want


def tokens(text):
    return len(re.findall(r"\w+|[^\s]", text))


ODD = ["", None, "\\", "\\l<", "</turn>\n", "<turn user>hi</turn>", "\\b\\g>", "a < b > c", "🙂 é\n\n", "\\\\<", "word " * 300, "x"]


def odd_rows(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for k in range(rng.randint(1, 30)):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "to>ol<"])
            rows.append((conv, rng.choice([k, k, 3, None, k * 2000]), role, rng.choice(ODD)))
    return rows


@pytest.mark.parametrize("budget,history", [(4, 0), (16, 4), (64, 16), (1024, 256)])
def test_round_trip(spark, budget, history):
    rows = odd_rows()
    windows = chat.formatted(table(spark, rows), budget, history)
    check_digest(rows, chat.digest(windows).collect())


def test_windows(spark):
    """Aligned, in budget, system turn retained, limited history, masked repeats."""
    rng = random.Random(9)
    rows = []
    for conv in range(40):
        turns = [("system", "you are " + "very " * rng.randint(0, 8) + "kind")] if conv % 2 else []
        turns += [(("user", "assistant")[k % 2], " ".join([f"w{conv}_{k}"] * rng.randint(1, 30))) for k in range(rng.randint(1, 40))]
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(turns)]
    budget, history = 100, 25
    out = chat.formatted(table(spark, rows), budget, history).collect()
    repeated = 0
    for conv, turns in by_conv(rows).items():
        sizes = [tokens(t) for _, t in turns]
        seen = 0
        for w in sorted((r for r in out if r.conv_id == conv), key=lambda r: r.window):
            parts = re.findall(r"<turn (.*?)>(.*?)</turn>\n", w.text, flags=re.S)
            assert "".join(f"<turn {r}>{t}</turn>\n" for r, t in parts) == w.text
            new = parts[w.n_context:]
            assert new == turns[seen:seen + len(new)]
            context = parts[:w.n_context]
            if turns[0][0] == "system" and seen:
                assert context[0] == turns[0]
                context = context[1:]
            assert context == turns[seen - len(context):seen]
            assert sum(tokens(t) for _, t in context) <= history
            repeated += len(context)
            assert w.tokens == sum(tokens(t) for _, t in parts)
            assert w.tokens <= budget or len(new) == 1
            assert [w.text[s.start:s.start + s.length] for s in w.loss] == [t for r, t in new if r == "assistant"]
            seen += len(new)
        assert seen == len(turns) and sum(sizes) >= 0
    assert repeated > 50


def test_empty(spark):
    assert chat.digest(chat.formatted(table(spark, []))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, k, r, r"\### Assistant: </turn> ok") for k, r in enumerate(["user", "assistant"])]
    df = op10_chat(spark, sf)
    check_digest(rows, df.collect())
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_token_column_and_marks_are_the_budget(spark):
    """Windows by a tokenizer's counts, marks included, from the trees of the token counts."""
    from millrun.llm import tokencount
    rng = random.Random(3)
    rows = [(c, k, ("user", "assistant")[k % 2], " ".join(["\u5b66\u6821", "word", "x;y"][rng.randrange(3)] for _ in range(rng.randint(1, 25))))
            for c in range(12) for k in range(rng.randint(5, 60))]
    df = table(spark, rows).withColumn("doc_id", F.monotonically_increasing_id()).checkpoint()
    counted = tokencount.built(df.select("doc_id", "text")).select(F.col("doc_id").alias("of"), F.col("n_tokens").alias("size"))
    given = df.join(counted, F.col("doc_id") == F.col("of"))
    sizes = {(r.conv_id, r.turn): r["size"] for r in given.collect()}
    out = chat.formatted(given, 120, 30, tokens="size", marks=6).collect()
    seen = {}
    for w in sorted(out, key=lambda r: (r.conv_id, r.window)):
        n = w.text.count("</turn>")
        first = seen.get(w.conv_id, 0) - w.n_context
        own = [sizes[w.conv_id, k] + 6 for k in range(first, first + n)]
        assert w.tokens == sum(own) and (w.tokens <= 120 or n - w.n_context == 1) and sum(own[:w.n_context]) <= 30
        seen[w.conv_id] = first + n
    assert sum(seen.values()) == len(rows)
    check_digest(rows, chat.digest(chat.formatted(given, 120, 30, tokens="size", marks=6)).collect())


def test_one_hot_conversation_without_turn_numbers(spark):
    """All rows of one conversation, equal rows among them, spread over the ranges."""
    from millrun.llm.common import numbered_cells
    rows = [(5, None, "assistant", f"text {i % 40} " * 3) for i in range(400)]
    check_digest(rows, chat.digest(chat.formatted(table(spark, rows), 64, 16)).collect())
    cells = numbered_cells(table(spark, rows).select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"])[1].collect()
    assert len(cells) > 4 and max(b["_before"] for b in cells) < 400 and {b["_all"] for b in cells} == {400}
