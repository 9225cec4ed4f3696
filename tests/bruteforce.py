"""Small pure-Python restatements of order-dependent rules, for tests only."""

from __future__ import annotations

from difflib import SequenceMatcher


def similarity(a_content, b_content, a_title, b_title):
    if not a_content or not b_content:
        return 0.0
    s = SequenceMatcher(None, a_content, b_content).ratio()
    if a_title and b_title:
        s = s * 0.8 + SequenceMatcher(None, a_title, b_title).ratio() * 0.2
    return s


def greedy_near_dups(rows, threshold=0.9, drift=False):
    """rows: dicts with ord, batch, norm_content, norm_title, quality in input order.

    Returns {ord: survivor_ord_of_its_slot}.  ``drift=True`` compares later rows
    with the slot's current occupant (the original's behaviour); ``False``
    compares with the slot's first row (the leader).
    """
    out = {}
    by_batch = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        by_batch.setdefault(r["batch"], []).append(r)
    for batch_rows in by_batch.values():
        slots = []  # [leader_row, occupant_row, members]
        for r in batch_rows:
            placed = False
            for slot in slots:
                ref = slot[1] if drift else slot[0]
                if similarity(r["norm_content"], ref["norm_content"], r["norm_title"], ref["norm_title"]) >= threshold:
                    if r["quality"] > slot[1]["quality"]:
                        slot[1] = r
                    slot[2].append(r["ord"])
                    placed = True
                    break
            if not placed:
                slots.append([r, r, [r["ord"]]])
        for leader, occupant, members in slots:
            for m in members:
                out[m] = occupant["ord"]
    return out
