"""DuckDB twin of the recursive splitter (C1), used only as the oracle of the C1 queries.

Same level-by-level plan as ``operators.chunking.recursive_chunks``: choose the first separator
present, split keeping it in front, pack runs of short pieces with a fold over integer state,
hand long pieces to the next level, fixed windows for the empty separator."""

from __future__ import annotations

from .fixtures import STRIP_SQL

ITEM = "STRUCT(txt VARCHAR, nxt INTEGER)[]"


def _lit(s: str) -> str:
    if s == "":
        return "''"
    parts = s.replace("'", "''").split("\n")
    return "(" + " || chr(10) || ".join(f"'{p}'" if p else "''" for p in parts) + ")"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '{STRIP_SQL}', '', 'g')"


def level(t: str, frm: str, size: int, overlap: int, seps: list[str]) -> str:
    m = len(seps)
    whens = " ".join(
        f"WHEN {frm} <= {i} {'' if s == '' else f'AND instr({t}, {_lit(s)}) > 0'} THEN {i}" for i, s in enumerate(seps))
    choice = f"CASE {whens} ELSE {m - 1} END"
    seps_arr = "[" + ", ".join(_lit(s) for s in seps) + "]"
    sep = f"{seps_arr}[c + 1]"
    pieces = (f"list_filter(list_transform(string_split({t}, {sep}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {sep} || x END),"
              f" lambda x: x <> '')")
    nxt = f"CASE WHEN c + 1 < {m} THEN c + 1 ELSE -1 END"
    emit = f"[{{'txt': {_strip(f'substring({t}, acc.apos + 1, acc.tot)')}, 'nxt': -1}}]"
    lj = "L[i]"
    pop_init = f"{{'a': acc.a, 'apos': acc.apos, 'tot': acc.tot, 'pos': acc.pos, 'out': list_concat(acc.out, {emit})}}"
    pop_step = (f"lambda st, x: CASE WHEN st.tot > {overlap} OR (st.tot + {lj} > {size} AND st.tot > 0) "
                f"THEN {{'a': st.a + 1, 'apos': st.apos + L[st.a], 'tot': st.tot - L[st.a], 'pos': st.pos, 'out': st.out}} "
                f"ELSE st END")
    pop = (f"list_transform([list_reduce(range(acc.a, i), {pop_step}, {pop_init})], lambda st: "
           f"{{'a': st.a, 'apos': st.apos, 'tot': st.tot + {lj}, 'pos': st.pos + {lj}, 'out': st.out}})[1]")
    step = (f"CASE WHEN {lj} >= {size} THEN "
            f"{{'a': i + 1, 'apos': acc.pos + {lj}, 'tot': 0, 'pos': acc.pos + {lj}, "
            f"'out': list_concat(acc.out, CASE WHEN acc.tot > 0 THEN {emit} ELSE []::{ITEM} END, "
            f"[{{'txt': P[i], 'nxt': {nxt}}}])}} "
            f"WHEN acc.tot + {lj} > {size} AND acc.tot > 0 THEN {pop} "
            f"ELSE {{'a': acc.a, 'apos': acc.apos, 'tot': acc.tot + {lj}, 'pos': acc.pos + {lj}, 'out': acc.out}} END")
    init = f"{{'a': 1, 'apos': 0, 'tot': 0, 'pos': 0, 'out': []::{ITEM}}}"
    folded = f"list_reduce(range(1, len(P) + 1), lambda acc, i: {step}, {init})"
    finish = f"list_transform([{folded}], lambda acc: CASE WHEN acc.tot > 0 THEN list_concat(acc.out, {emit}) ELSE acc.out END)[1]"
    merge = f"CASE WHEN len(P) = 0 THEN []::{ITEM} ELSE {finish} END"
    packed = f"list_transform([{pieces}], lambda P: list_transform([list_transform(P, lambda x: length(x))], lambda L: {merge})[1])[1]"
    step_w = size - overlap
    n = f"greatest(1, CAST(ceil((length({t}) - {overlap}) / {step_w}.0) AS BIGINT))"
    window = (f"list_transform(range(0, {n}), lambda k: {{'txt': {_strip(f'substring({t}, CAST(k * {step_w} + 1 AS BIGINT), {size})')},"
              f" 'nxt': -1}})")
    return f"list_transform([{choice}], lambda c: CASE WHEN {sep} = '' THEN {window} ELSE {packed} END)[1]"


def measured_level(t: str, frm: str, measure, size: int, overlap: int, seps: list[str]) -> str:
    """As ``level``, by any measure of pieces (P3): windows are runs of pieces, the empty separator gives code points."""
    m = len(seps)
    choice = "CASE " + " ".join(
        f"WHEN {frm} <= {i} {'' if s == '' else f'AND instr({t}, {_lit(s)}) > 0'} THEN {i}" for i, s in enumerate(seps)) + f" ELSE {m - 1} END"
    sep = "[" + ", ".join(_lit(s) for s in seps) + "][c + 1]"
    pieces = (f"CASE WHEN {sep} = '' THEN regexp_extract_all({t}, '(?s).') ELSE list_filter(list_transform(string_split({t}, {sep}), "
              f"lambda x, i: CASE WHEN i = 1 THEN x ELSE {sep} || x END), lambda x: x <> '') END")
    run = lambda a, e: f"array_to_string(P[{a} : {e}], '')"
    emit = lambda e: f"[{{'txt': {_strip(run('acc.a', e))}, 'nxt': -1}}]"
    rest = f"CASE WHEN c + 1 < {m} AND {sep} <> '' THEN c + 1 ELSE -1 END"
    drop = (f"list_reduce(range(acc.a, i), lambda st, x: CASE WHEN st.tot > {overlap} OR (st.tot + L[i] > {size} AND st.tot > 0) "
            f"THEN {{'a': st.a + 1, 'tot': st.tot - L[st.a], 'out': st.out}} ELSE st END, "
            f"{{'a': acc.a, 'tot': acc.tot, 'out': list_concat(acc.out, {emit('i - 1')})}})")
    step = (f"CASE WHEN L[i] >= {size} THEN {{'a': i + 1, 'tot': 0, 'out': list_concat(acc.out, CASE WHEN acc.a < i THEN {emit('i - 1')} "
            f"ELSE []::{ITEM} END, [{{'txt': P[i], 'nxt': {rest}}}])}} "
            f"WHEN acc.tot + L[i] > {size} AND acc.a < i THEN list_transform([{drop}], lambda st: "
            f"{{'a': st.a, 'tot': st.tot + L[i], 'out': st.out}})[1] "
            f"ELSE {{'a': acc.a, 'tot': acc.tot + L[i], 'out': acc.out}} END")
    folded = f"list_reduce(range(1, len(P) + 1), lambda acc, i: {step}, {{'a': 1, 'tot': 0, 'out': []::{ITEM}}})"
    done = f"list_transform([{folded}], lambda acc: CASE WHEN acc.a <= len(P) THEN list_concat(acc.out, {emit('len(P)')}) ELSE acc.out END)[1]"
    merge = f"CASE WHEN len(P) = 0 THEN []::{ITEM} ELSE {done} END"
    return (f"list_transform([{choice}], lambda c: list_transform([{pieces}], lambda P: "
            f"list_transform([list_transform(P, lambda x: {measure('x')})], lambda L: {merge})[1])[1])[1]")


def measured_rows_sql(measure, size: int, overlap: int, seps: list[str]) -> str:
    items = measured_level("text", "0", measure, size, overlap, seps)
    for _ in range(len(seps) - 1):
        inner = measured_level("it.txt", "it.nxt", measure, size, overlap, seps)
        items = f"flatten(list_transform({items}, lambda it: CASE WHEN it.nxt < 0 THEN [it] ELSE {inner} END))"
    return _rows(f"list_transform(list_filter({items}, lambda z: z.txt <> ''), lambda z: z.txt)")


def recursive_chunks_sql(text: str, size: int, overlap: int, seps: list[str]) -> str:
    items = level(text, "0", size, overlap, seps)
    for _ in range(len(seps) - 1):
        inner = level("it.txt", "it.nxt", size, overlap, seps)
        items = f"flatten(list_transform({items}, lambda it: CASE WHEN it.nxt < 0 THEN [it] ELSE {inner} END))"
    return f"list_transform(list_filter({items}, lambda z: z.txt <> ''), lambda z: z.txt)"


def chunk_rows_sql(size: int, overlap: int, seps: list[str]) -> str:
    return _rows(recursive_chunks_sql("text", size, overlap, seps))


def _rows(expr: str) -> str:
    return f"""
SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, CAST(i - 1 AS INTEGER) AS chunk_index,
       CAST(len(ch) AS INTEGER) AS total_chunks, ch[i] AS chunk_text
FROM (SELECT doc_id, ch, unnest(range(1, len(ch) + 1)) AS i FROM (SELECT doc_id, {expr} AS ch FROM documents))"""
