"""Synopsis sections against a plain greedy version, on labelled chunks with repeats, nulls and long texts."""

from __future__ import annotations

import random
import re

from tidemark.operators import memory, synopsis

SCHEMA = "session_id string, chunk_id string, observed_from string, observed_to string, display_text string"


def plain_blocks(shown: str, label: str) -> list[str]:
    found, current = [], None
    for part in re.split(r"(?:^|\n\n)((?:User|Assistant|Tool call|Tool result)(?: \(continued\))?:)", shown):
        if re.fullmatch(r"(?:User|Assistant|Tool call|Tool result)(?: \(continued\))?:", part):
            current = part.removesuffix(":").removesuffix(" (continued)")
        elif current == label and part.startswith("\n") and part.strip():
            found.append(part.strip())
    return found


def plain_section(quotes: list[tuple[str, str]], most: int, evidence: int) -> tuple[str, list[str]] | None:
    kept, seen, used = [], set(), 0
    for chunk, quote in quotes:
        flat = " ".join(quote.split())
        if not flat or flat in seen:
            continue
        room = most - used
        if room <= 0 or len(kept) == evidence:
            break
        cut = flat if len(flat) <= room else flat[:1] if room == 1 else flat[: room - 1].rstrip() + "…"
        seen.add(flat)
        kept.append((chunk, cut))
        used += len(cut) + (len(kept) > 1)
    return ("\n".join(t for _, t in kept), [c for c, _ in kept]) if kept else None


def plain(chunks: list[tuple], most: int, evidence: int) -> dict:
    out = {}
    for session in {c[0] for c in chunks}:
        own = sorted((c[2] or "", c[1], c[4] or "") for c in chunks if c[0] == session)
        quotes = {
            "goal": [(i, b) for _, i, t in own for b in plain_blocks(t, "User")][: synopsis.GOAL_BLOCKS],
            "current_state": [(i, b) for _, i, t in own for b in plain_blocks(t, "Assistant")][-synopsis.STATE_BLOCKS :],
            "recent_changes": [(i, t) for _, i, t in own[-synopsis.RECENT_CHUNKS :]],
        }
        for name, pattern in synopsis.LINES.items():
            quotes[name] = [(i, line.strip()) for _, i, t in own for line in t.split("\n") if re.search(pattern, line.strip(), re.ASCII)]
        for name, of in quotes.items():
            if (made := plain_section(of, most, evidence)) is not None:
                out[session, name] = made
    return out


def some_chunks(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["must", "keep", "src/a.ts", "error", "failed", "decided", "TODO", "why?", "plain", "x" * 40, "  ", "only", "\n", "main.py", "risk"]
    chunks = []
    for n in range(60):
        parts = [
            f"{rng.choice(synopsis.LABELS)}{rng.choice(['', ' (continued)'])}:\n" + " ".join(rng.choices(words, k=rng.randint(0, 30)))
            for _ in range(rng.randint(0, 4))
        ]
        at = rng.choice([None, f"2024-01-{rng.randint(1, 28):02d}T00:00:00.000Z"])
        chunks.append((f"s{n % 7}", f"c{n:03d}", at, at, rng.choice(["\n\n".join(parts)] * 9 + [None])))
    return chunks


def test_sections_against_plain(spark):
    for seed, most, evidence in ((1, 1200, 5), (2, 128, 5), (3, 130, 20), (4, 400, 1)):
        chunks = some_chunks(seed)
        rows = synopsis.sections(spark.createDataFrame(chunks, SCHEMA), most, evidence).collect()
        assert {(r["session_id"], r["name"]): (r["section"], r["evidence_ids"]) for r in rows} == plain(chunks, most, evidence)


def test_a_cut_first_excerpt_leaves_room(spark):
    shown = "User:\n" + "a" * 126 + " bbbb\n\nUser:\nsecond"
    chunks = [("s", "c", None, None, shown)]
    rows = synopsis.sections(spark.createDataFrame(chunks, SCHEMA), 128, 5).collect()
    assert {(r["session_id"], r["name"]): (r["section"], r["evidence_ids"]) for r in rows} == plain(chunks, 128, 5)
    assert next(r["section"] for r in rows if r["name"] == "goal") == "a" * 126 + "…\ns"


def test_synopses_of_empty_and_titled_chunks(spark):
    assert synopsis.synopses(spark.createDataFrame([], SCHEMA)).collect() == []
    shown = "User:\nWe must ship\n\nAssistant:\nDone"
    made = synopsis.synopses(spark.createDataFrame([("s", "c", "2024-01-01", "2024-01-02", shown), ("t", "d", None, None, None)], SCHEMA)).collect()
    assert [r["session_id"] for r in made] == ["s"]
    assert made[0]["body"] == f"Goal\nWe must ship\n\nCurrent state\nDone\n\nConstraints\nWe must ship\n\nRecent changes\n{' '.join(shown.split())}"
    assert (made[0]["evidence_ids"], made[0]["observed_from"], made[0]["observed_to"]) == (["c"], "2024-01-01", "2024-01-02")


def test_decisions_carry_what_stands_beside_them(spark):
    told = (
        "We decided to use src/a.ts instead of b.ts because it is fast. We rejected the queue because it is slow. "
        "Redis was weighed. It must stay small. It can't grow."
    )
    rows = [(1, "c", "2024-01-01", told), (1, "d", None, "Decision: keep plain files."), (2, "e", None, None), (2, "f", None, "")]
    chunks = spark.createDataFrame(rows, "session_id long, chunk_id string, observed_at string, display_text string")
    found = memory.decisions(chunks)
    made = {r["chunk_id"]: r for r in found.collect()}
    assert set(made) == {"c", "d"}
    one = made["c"]
    assert (one["decision"], one["rationale"]) == ("use src/a.ts instead of b.ts", "it is fast.")
    assert [tuple(a) for a in one["alternatives"]] == [("b.ts", None), ("the queue", "it is slow.")]
    assert one["constraints"] == ["It must stay small.", "It can't grow."]
    assert one["entities"] == ["src/a.ts", "b.ts"]
    assert one["body"].split("\n")[1:] == [
        "Decision: use src/a.ts instead of b.ts", "Rationale: it is fast.", "Alternative rejected: b.ts", "Alternative rejected: the queue — it is slow.",
    ]
    assert one["supersedes_earlier"] and not made["d"]["supersedes_earlier"]
    assert made["d"]["body"].endswith("Rationale: No explicit rationale was captured.")
    assert [r["chunk_id"] for r in memory.decisions(chunks, 1).collect()] == ["d"]
