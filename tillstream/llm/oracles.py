"""Results of the operators in SQL on the tables, where SQL can express them."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_PRINTED = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, {_LETTERS}) as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, {_LETTERS}) as w from benchmark),
windows as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)
), sizes as (select distinct k from windows),
places as (
  select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d cross join sizes where len(w) >= k)
), hits as (select doc_id, i, k, item_id from places join windows using (g, k)),
words as (
  select doc_id, count(distinct x) as n
  from (select doc_id, unnest(range(i, i + k)) as x from (select distinct doc_id, i, k from hits)) group by doc_id
), items as (
  select doc_id, count(item_id) as n, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
  from (select distinct doc_id, item_id from hits) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(words.n, 0) as bigint) as n_hit,
  cast(coalesce(items.n, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(words.n, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

#: Repeats of 10 words cover a word; a repeat of more than 100 words is one of 101.
QUALITY_RULES = f"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_PRINTED}) as w from documents),
sizes as (select unnest([3, 10, 101]) as k),
places as (
  select doc_id, i, k, md5(array_to_string(w[i:i + k - 1], ' ')) as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d cross join sizes where len(w) >= k)
), again as (select doc_id, i, k from places qualify count(*) over (partition by doc_id, k, g) > 1),
covers as (
  select doc_id, k, count(distinct x) as n from (select doc_id, k, unnest(range(i, i + k)) as x from again)
  group by doc_id, k
), lines as (
  select doc_id, count(*) - count(distinct line) as n
  from (select doc_id, unnest(string_split(t, chr(10))) as line from d)
  where regexp_matches(line, {_PRINTED}) group by doc_id
), counted as (
  select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(lines.n, 0) as bigint) as n_dup_lines, cast(coalesce(c3.n, 0) as bigint) as n_repeat_words,
    coalesce(c10.n, 0) as covered, c101.n is not null as too_long
  from d left join lines using (doc_id)
    left join covers c3 on c3.doc_id = d.doc_id and c3.k = 3
    left join covers c10 on c10.doc_id = d.doc_id and c10.k = 10
    left join covers c101 on c101.doc_id = d.doc_id and c101.k = 101
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * covered <= 50 * n_words and not too_long as kept
from counted
"""

# The notices and their labels, as the operator has to find them.
_NOTICES = """
  (1, 'gpl', 'this work is licensed under the gnu general public license version 3'),
  (2, 'gpl', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation'),
  (3, 'lgpl', 'licensed under the gnu lesser general public license'),
  (4, 'agpl', 'licensed under the gnu affero general public license'),
  (5, 'apache', 'licensed under the apache license version 2 0'),
  (6, 'mit', 'released under the mit license'),
  (7, 'mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction'),
  (8, 'bsd', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  (9, 'bsd', 'released under the bsd license'),
  (10, 'mpl', 'this source code form is subject to the terms of the mozilla public license'),
  (11, 'cc-by', 'this work is licensed under a creative commons attribution 4 0 international license'),
  (12, 'cc-by-nc', 'licensed under cc by nc 4 0'),
  (13, 'cc-by-sa', 'licensed under cc by sa 4 0'),
  (14, 'cc-by', 'licensed under cc by 4 0'),
  (15, 'isc', 'released under the isc license'),
  (16, 'public-domain', 'this is free and unencumbered software released into the public domain'),
  (17, 'proprietary', 'copyright all rights reserved')
"""  # fmt: skip

LICENSE_SCAN = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, {_LETTERS}) as w from documents),
phrases(p, k, label) as (
  values ('gnu general public license', 4, 'gpl'), ('apache license', 2, 'apache'), ('cc by', 2, 'cc-by'),
    ('mit license', 2, 'mit')
), places as (
  select doc_id, i - 1 as place, label
  from (select doc_id, w, p, k, label, unnest(range(1, len(w) - k + 2)) as i from d cross join phrases
    where contains(array_to_string(w, ' '), p))
  where array_to_string(w[i:i + k - 1], ' ') = p
), base as (
  select doc_id, count(*) as n, min(place) as first_word, max(place) as last_word,
    string_agg(distinct label, ',' order by label) as labels
  from places group by doc_id
), notices(id, label, text) as (values {_NOTICES}),
wanted as (
  select id, any_value(label) as label, word, any_value(n + greatest(2, n // 4)) as width
  from (select id, label, len(string_split(text, ' ')) as n, unnest(string_split(text, ' ')) as word from notices) group by id, word
), sizes as (select id, count(*) as n from wanted group by id),
known as (
  select doc_id, id, label, width, place, word
  from (select doc_id, unnest(range(len(w))) as place, unnest(w) as word from d) join wanted using (word)
), likely as (
  select doc_id, id from known join sizes using (id) group by doc_id, id, n having count(distinct word) >= 0.9 * n - 1e-9
), blocks as (
  select a.doc_id, a.id, a.label, a.place, count(distinct b.word) as n
  from known a join likely using (doc_id, id)
    join known b on a.doc_id = b.doc_id and a.id = b.id and b.place >= a.place and b.place < a.place + a.width
  group by a.doc_id, a.id, a.label, a.place
), found as (
  select doc_id, label, blocks.n / sizes.n as share from blocks join sizes using (id) where blocks.n >= 0.9 * sizes.n - 1e-9
), every as (select doc_id, label from places union select doc_id, label from found),
named as (select doc_id, string_agg(label, ',' order by label) as labels from every group by doc_id),
best as (select doc_id, max(share) as share from found group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(base.n, 0) as bigint) as n_base,
  cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base.labels, '') as base_labels, coalesce(named.labels, '') as labels,
  case when base.n is not null then 1.0::double else coalesce(share, 0.0)::double end as score
from d left join base using (doc_id) left join named using (doc_id) left join best using (doc_id)
"""

SUFFIX_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
starts as (
  select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as g
  from (select doc_id, h, unnest(range(length(h) // 2 - 99)) as i from d where length(h) >= 200)
), later as (
  select doc_id, i from starts qualify row_number() over (partition by g order by doc_id, i) > 1
), cut as (
  select doc_id, i, coalesce(i > max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding)
    + 100, true) as fresh from later
), grouped as (select doc_id, i, sum(cast(fresh as int)) over (partition by doc_id order by i) as span from cut),
spans as (select doc_id, span, min(i) as a, max(i) + 100 as b from grouped group by doc_id, span),
sums as (select doc_id, count(*) as n, sum(b - a) as removed from spans group by doc_id),
edges as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from spans
  union all select d.doc_id, coalesce(max(spans.b), 0), any_value(length(h) // 2) from d left join spans using (doc_id)
  group by d.doc_id
), kept as (
  select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a, b) as h from edges join d using (doc_id)
  group by doc_id
)
select d.doc_id, cast(length(d.h) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed,
  cast(coalesce(n, 0) as bigint) as n_spans, sha256(unhex(kept.h)) as kept_sha256
from d join kept using (doc_id) left join sums using (doc_id)
"""

NEAR_DEDUP = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, {_PRINTED}) as w from documents),
sets as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as i from d where len(w) > 0)
), sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id
), linked as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * common.n >= 80 * (x.n + y.n - common.n)
), edges as (select a, b from linked union all select b, a from linked),
reached as (
  select doc_id as node, doc_id as other from sizes
  union select reached.node, edges.b from reached join edges on edges.a = reached.other
), smallest as (select node, min(other) as component_id from reached group by node)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(component_id, d.doc_id) as component_id,
  coalesce(component_id, d.doc_id) = d.doc_id as kept
from d left join sizes using (doc_id) left join smallest on node = d.doc_id
"""

RANKED_SEARCH = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, {_LETTERS}) as w from documents),
sums as (select count(*) filter (where len(w) > 0) as n, coalesce(sum(len(w)), 0)::bigint as l from d),
sizes as (select r, doc_id, 50 + (50 * len(w) * n) // l as m from d cross join sums where len(w) > 0),
tf as (select r, t, count(*) as tf from (select r, unnest(w) as t from d) group by r, t),
weights as (select t, cast(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) as bigint) as w from tf cross join sums group by t),
items as (select row_number() over () as q, item_id, regexp_extract_all({_LOWER}, {_LETTERS}) as w from benchmark),
terms as (select distinct q, item_id, unnest(w) as t from items),
scores as (
  select q, item_id, r, doc_id, cast(sum(weights.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
  from terms join weights using (t) join tf using (t) join sizes using (r) group by q, item_id, r, doc_id
), ranked as (
  select q, item_id, doc_id, score, row_number() over (partition by q order by score desc, doc_id nulls last) as rank
  from scores where score > 0
)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 50
"""


def _crc_of_byte(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


_CRC_TABLE = "[" + ", ".join(f"{_crc_of_byte(byte)}::bigint" for byte in range(256)) + "]"


def _crc32(text: str) -> str:
    """CRC-32 of a text's bytes in SQL: one step for each byte, with a table of the 256 steps."""
    numbers = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: cast('0x' || h as bigint))"
    step = "xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({numbers}, lambda c, b: {step}, 4294967295::bigint), 4294967295::bigint)"


SHARDING = f"""
with crc as (select {_CRC_TABLE} as t),
d as (
  select doc_id, coalesce(cast(doc_id as varchar), '-') as k,
    octet_length(encode(coalesce(text, ''))) + 16 as size, {_crc32("coalesce(text, '')")} as text_crc32
  from documents cross join crc
), draws as (
  select k, s, cast('0x' || substr(sha256(k || ':' || (s // 8)), 1 + 8 * (s % 8), 8) as bigint) as x
  from (select distinct k from d), (select unnest(range(41)) as s)
), best as (
  select k, arg_min(s, (-ln((x + 0.5) / 4294967296.0), s)) filter (where s < 40) as shard,
    arg_min(s, (-ln((x + 0.5) / 4294967296.0), s)) as grown_shard
  from draws group by k
)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'key' as law,
  cast(shard as int) as shard,
  row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot,
  cast(grown_shard as int) as grown_shard
from d join best using (k)
"""

#: Levels of a tree in the SQL: up to 16 ** 4 documents of a source, and as many sources.
_LEVELS = 4


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(cast({value} as varchar))) || ':' || cast({value} as varchar), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _level(tree: str, k: int) -> str:
    """From the nodes (t, i, h) of level ``k``, with what is left and right of each, to those of the next."""
    return f"""
{tree}_run{k} as (
  select t, i, h, count(*) over (partition by t) as n,
    coalesce(string_agg(h, '') over (partition by t, i // 16 order by i rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(h, '') over (partition by t, i // 16 order by i rows between 1 following and unbounded following), '') as r
  from {tree}{k}
), {tree}{k + 1} as (
  select t, i // 16 as i, case when n > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end as h
  from {tree}_run{k} group by t, i // 16, n
), """


def _fold(leaf: str, tree: str) -> str:
    for k in range(_LEVELS):
        at = f"{tree}_p{k}"
        leaf = f"case when {at}.n > 1 then sha256({at}.l || {leaf} || {at}.r) else {leaf} end"
    return leaf


def _beside(tree: str) -> str:
    return " || ".join(f"{tree}_p{k}.l || {tree}_p{k}.r" for k in range(_LEVELS))


def _path(tree: str, t: str, i: str) -> str:
    joins = (f"join {tree}_run{k} {tree}_p{k} on {tree}_p{k}.t = {t} and {tree}_p{k}.i = {i} // {16 ** k}" for k in range(_LEVELS))
    return " ".join(joins)


MERKLE = f"""
with crc as (select {_CRC_TABLE} as t),
d as (
  select doc_id, coalesce('=' || source, '-') as t, {_leaf("text")} as h,
    case when doc_id is not null and {_crc32("cast(doc_id as varchar)")} % 5 = 0
      then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as changed
  from documents cross join crc
), a0 as (
  select t, row_number() over (partition by t order by doc_id nulls first, h) - 1 as i, h, doc_id, changed from d
), {"".join(_level("a", k) for k in range(_LEVELS))}
b0 as (select '' as t, row_number() over (order by a.t) - 1 as i, a.h, a.t as source from a{_LEVELS} a),
{"".join(_level("b", k) for k in range(_LEVELS))}
paths as (
  select a0.doc_id, a0.h as leaf, b0.h as subroot, b{_LEVELS}.h as root, sha256({_beside("a")} || {_beside("b")}) as proof_sha256,
    {_fold("coalesce(a0.changed, a0.h)", "a")} as below, b0.i as top
  from a0 {_path("a", "a0.t", "a0.i")} join b0 on b0.source = a0.t {_path("b", "''", "b0.i")} cross join b{_LEVELS}
), folded as (select paths.*, {_fold("below", "b")} as folded_root from paths {_path("b", "''", "paths.top")})
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": DECONTAMINATION,
    "op3_quality_rules": QUALITY_RULES,
    "op4_license_scan": LICENSE_SCAN,
    "op5_suffix_dedup": SUFFIX_DEDUP,
    "op7_near_dedup": NEAR_DEDUP,
    "op11_ranked_search": RANKED_SEARCH,
    "op12_merkle_manifest": MERKLE,
    "op13_sharding": SHARDING,
}
