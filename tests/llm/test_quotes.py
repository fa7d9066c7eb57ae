"""Quotation links against a plain linker, on the given conversations with nested quotations put in."""

import random
import re
from collections import defaultdict

import pytest

from fleetlens.llm import quotes


def sentences(text):
    return [s for s in re.split(r"(?<=[.!?])\s+", " ".join(text.split()).lower()) if s]


def parsed(text):
    """Own lines, and passages as (level, text)."""
    own, passages, last = [], [], 0
    for line in (text or "").split("\n"):
        m = re.match(r"((?:> )+)(.*)", line)
        if not m:
            own.append(line)
            last = 0
            continue
        level = len(m[1]) // 2
        if level != last:
            passages.append([level, ""])
        passages[-1][1] += "\n" + m[2]
        last = level
    return "\n".join(own).strip(), passages


def plain_links(rows):
    """(conv, turn): (reply_to, n_linked), by looking through all earlier turns for each passage."""
    said = defaultdict(dict)
    for conv, turn, text in rows:
        said[conv].setdefault(turn, []).append(sentences(parsed(text)[0]))
    out = {}
    by_turn = defaultdict(list)
    for conv, turn, text in rows:
        by_turn[conv, turn] += parsed(text)[1]
    for (conv, turn), passages in by_turn.items():
        def speakers(run):
            n = len(run)
            return [t for t in sorted(said[conv]) if t < turn and any(
                x[i:i + n] == run for x in said[conv][t] for i in range(len(x) - n + 1))]
        votes = defaultdict(lambda: [0, 0, 0])
        for level, text in passages:
            run = sentences(text)
            if not run:
                continue
            whole = speakers(run)
            for part in [run] if whole else [[x] for x in run]:
                who = speakers(part)
                if who:
                    v, chars = votes[level, who[-1]], sum(map(len, part))
                    v[0] += chars if len(who) == 1 else 0
                    v[1] += chars * 1000000 // len(who)
                    v[2] += len(part)
        if votes:
            best = max((-level, v[0], v[1], who) for (level, who), v in votes.items())
            out[conv, turn] = (best[3], sum(v[2] for v in votes.values()))
    return out


def quoting(given, seed):
    """The conversations, where later turns quote earlier ones: whole, in part, nested, changed, or more than one."""
    rng, out, texts = random.Random(seed), [], defaultdict(dict)
    for conv, turn, text in given:
        text = "\n".join(line for line in (text or "").split("\n") if not line.startswith(">"))
        parts = []
        for _ in range(rng.choice([0, 1, 1, 2]) if texts[conv] else 0):
            old = texts[conv][rng.choice(list(texts[conv]))]
            lines = ["> " + x for x in old.split("\n")]
            own = sentences(parsed(old)[0])
            if own and rng.random() < 0.5:
                k = rng.randrange(len(own))
                lines = ["> " + x for x in own[k:k + rng.randint(1, 4)]]
            if rng.random() < 0.2:
                lines.append("> This was never said.")
            parts.append("\n".join(lines))
        if rng.random() < 0.3:
            text += "\nThank you very much for that."
        texts[conv][turn] = "\n\n".join([*parts, text])
        out.append((conv, turn, texts[conv][turn]))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_links_equal_a_plain_linker(spark, small, hot):
    given = sorted((0 if hot else r.conv_id, r.conv_id * 100 + r.turn if hot else r.turn, r.text)
                   for r in spark.read.parquet(f"{small}/conversations.parquet").limit(250).collect())
    rows = quoting(given, 5 + hot)
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(4)
    out = quotes.reply_order(df).collect()
    want = plain_links(rows)
    assert {(r.conv_id, r.turn): (r.reply_to, r.n_linked) for r in out if r.reply_to is not None} == want
    assert len(want) > 50 and len(out) == len(rows)
    text = {(c, t): parsed(x)[0] for c, t, x in rows}
    up = {k: v for k, (v, _) in want.items()}
    for r in out:
        assert r.text == text[r.conv_id, r.turn]
        root, depth = r.turn, 0
        while (r.conv_id, root) in up:
            root, depth = up[r.conv_id, root], depth + 1
        assert (r.thread, r.depth) == (root, depth)
    for conv in {r.conv_id for r in out}:
        mine = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.thread, r.depth, r.turn) for r in mine] == sorted((r.thread, r.depth, r.turn) for r in mine)


def test_many_sizes_of_passages_cost_little(spark):
    """Passages of 300 lengths in one conversation with a message of 3,000 sentences."""
    long = [f"Sentence number {i} of it." for i in range(3000)]
    rows = [(1, 0, "u", " ".join(long))] + [(1, k, "u", "\n".join("> " + x for x in long[k:2 * k])) for k in range(1, 301)]
    out = quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.reply_to == 0 and r.n_linked == r.turn for r in out if r.turn)
