"""SQL that says what the cue folds say: recursive queries over segments, tokens and cues, written from the rules."""

from __future__ import annotations

SPACES = r"[\t\n\v\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
ENDS = """'[.!?。！？…]["''”’)\\]]*$'"""
CLAUSE = """'[,;:，、；：]["''”’)\\]]*$'"""
CJK = r"\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff00}-\x{ffef}"
NO_SPACE = r"\x{0e00}-\x{0e7f}\x{0e80}-\x{0eff}\x{1000}-\x{109f}" + CJK
NO_LINE_START = "、，。．！？：；）〕】》」』〉’”…・"


def clean(x: str) -> str:
    """Collapsed white space, spaces around punctuation put right, a lone i as I; characters are walked, as patterns cannot look around."""
    letter = "'^[A-Za-z]$'"
    gap = f"""l[i] in (',', '.', ';', ':', '!', '?') and i < len(l) and l[i+1] not in (' ', '"', '''')
      and not (l[i] in ('.', ',', ':') and i > 1 and regexp_matches(l[i-1], '^[0-9]$') and regexp_matches(l[i+1], '^[0-9]$'))
      and not (l[i] = '.' and i > 1 and regexp_matches(l[i-1], {letter}) and regexp_matches(l[i+1], {letter}) and not (i > 2 and regexp_matches(coalesce(l[i-2], ''), {letter})))"""
    chars = rf"string_split(regexp_replace(trim(regexp_replace({x}, '{SPACES}', ' ', 'g')), ' +([,.;:!?])', '\1', 'g'), '')"
    return rf"""trim(regexp_replace(list_transform([{chars}], lambda l: array_to_string(list_transform(range(1, len(l) + 1), lambda i: case when {gap} then l[i] || ' ' else l[i] end), ''))[1], '\bi\b', 'I', 'g'))"""


def spaceless(x: str, at: str = "^") -> str:
    """Whether a text starts (or ends: ``at`` is $) with a character of a script without word spaces."""
    return f"regexp_matches({x}, '{'^' if at == '^' else ''}[{NO_SPACE}]{'$' if at == '$' else ''}')"


def wrap(x: str) -> str:
    """Of a clean text the two lines of least overflow, without a lone word if possible, of best balance, the first of these.

    A second line begins after a space, or between two characters of scripts without spaces, the latter not a closing mark.
    """
    first, second = "left(c, j - 1 - (c[j - 1] = ' ')::int)", "substr(c, j)"
    able = f"c[j] <> ' ' and (c[j - 1] = ' ' or ({spaceless('c[j - 1]')} and {spaceless('c[j]')} and not contains('{NO_LINE_START}', c[j])))"
    rank = f"""{{'o': greatest(0, length({first}) - 42) + greatest(0, length({second}) - 42), 'n': ({words_in(first)} = 1 or {words_in(second)} = 1)::int, 'b': abs(length({first}) - length({second})), 'j': j}}"""
    best = f"list_min(list_transform(list_filter(range(2, length(c) + 1), lambda j: {able}), lambda j: {rank}))"
    return f"""list_transform([{x}], lambda c: case when length(c) <= 42 then c else coalesce(list_transform([{best}], lambda b: case when b is not null then left(c, b.j - 1 - (c[b.j - 1] = ' ')::int) || chr(10) || substr(c, b.j) end)[1], c) end)[1]"""


def joined(left: str, right: str) -> str:
    return f"case when {left} = '' then {right} when {right} = '' then {left} when {spaceless(left, '$')} or {spaceless(right)} then {left} || {right} else {left} || ' ' || {right} end"


def joined_all(texts: str) -> str:
    return f"list_reduce({texts}, lambda a, b: {joined('a', 'b')})"


def words_in(x: str) -> str:
    return f"(len(regexp_extract_all({x}, '[{NO_SPACE}]')) + len(list_filter(regexp_split_to_array(regexp_replace({x}, '[{NO_SPACE}]', ' ', 'g'), '{SPACES}'), lambda w: w <> '')))"


def bare(ws: str) -> str:
    return f"list_filter(list_transform({ws}, lambda w: regexp_replace(lower(w), '[^a-z0-9'']', '', 'g')), lambda w: w <> '')"


def total(xs: str) -> str:
    """Added up from the left, starting with 0."""
    return f"list_reduce(list_prepend(0.0::double, {xs}), lambda a, b: a + b)"


def token_ctes(base: str) -> str:
    """``said`` (transcript_id, i, text, s, e, speaker): tokens of ``base`` (transcript_id, pos, text, s, e, speaker)."""
    return f"""t0 as (select transcript_id, pos, s, e, speaker, lead(s) over (partition by transcript_id order by pos) nx, list_filter(string_split({clean("text")}, ' '), lambda w: w <> '') w from {base}),
t1 as (select transcript_id, row_number() over q k, s, case when e > s then e when nx > s then nx else s + greatest(len(w) * 0.35::double, 1.2::double) end e, speaker, w, list_transform(w, lambda x: length(x)) wt from t0 where len(w) > 0 window q as (partition by transcript_id order by pos)),
t2 as (select *, coalesce(s < lag(e) over (partition by transcript_id order by k), false) again, {bare("w")} head from t1),
fold(transcript_id, k, memory, until, w, ats, speaker) as (
  select transcript_id, 0::bigint, []::varchar[], null::double, []::varchar[], []::double[], null::varchar from t2 where k = 1
  union all
  select transcript_id, k, case when n = 0 then memory else list_concat(memory, rest)[-16:] end, case when n = 0 then until else ats[-1] end, rest, ats, speaker from (
    select *, list_transform(range(0, n + 1), lambda i: begin_ + {total("list_transform(rest_wt[1:i], lambda x: x::double / list_sum(rest_wt))")} * span) ats from (
      select *, case when e - begin_ >= n * 0.01::double - 0.000001::double then e - begin_ else begin_ + n * 0.35::double - begin_ end span from (
        select *, w[cut + 1:] rest, wt[cut + 1:] rest_wt, len(w) - cut n, greatest(s + greatest(e - s, 0.01::double) * coalesce(list_sum(wt[1:cut]), 0)::double / list_sum(wt)::double, coalesce(until, '-infinity'::double)) begin_ from (
          select t2.*, fold.memory, fold.until, coalesce(list_max(list_filter(range(case when again then 1 else 3 end, least(16, len({bare("fold.memory")}), len(head)) + 1), lambda n: ({bare("fold.memory")})[len({bare("fold.memory")}) - n + 1:] = head[1:n])), 0) cut
          from fold join t2 on t2.transcript_id = fold.transcript_id and t2.k = fold.k + 1))))),
said as (select transcript_id, row_number() over (partition by transcript_id order by k, j) i, w[j] as text, ats[j] s, ats[j + 1] e, speaker from (select *, unnest(range(1, len(w) + 1)) j from fold where len(w) > 0))"""


def cue_ctes(source: str = "said") -> str:
    """``cue`` (transcript_id, pos, text, s, e, speaker) of tokens (transcript_id, i, text, s, e, speaker)."""
    full = f"""length({clean("longer")}) > 78 or (now_ >= 1.2 and regexp_matches(c.last_text, {ENDS})) or (then_ > 6.5 and length({clean("c.joined")}) >= 24)
      or (now_ >= 4.5 and length({clean("c.joined")}) >= 56 and regexp_matches(c.last_text, {CLAUSE}))"""
    both = clean(joined("m.txt", "k.txt"))
    return f"""cut(transcript_id, i, n, first_s, last_e, last_text, joined, speaker, opens) as (
  select transcript_id, i, 1, s, e, text, text, speaker, 1 from {source} where i = 1
  union all
  select transcript_id, i, case when stop then 1 else n + 1 end, case when stop then s else first_s end, e, text, case when stop then text else longer end, speaker, stop::int from (
    select c.transcript_id, t.i, c.n, c.first_s, t.s, t.e, t.text, t.speaker, c.longer, c.speaker is distinct from t.speaker or (c.n >= 3 and ({full})) stop from (
      select c.*, {joined("c.joined", "t.text")} longer, c.last_e - c.first_s now_, t.e - c.first_s then_ from cut c join {source} t on t.transcript_id = c.transcript_id and t.i = c.i + 1) c
    join {source} t on t.transcript_id = c.transcript_id and t.i = c.i + 1)),
c0 as (select *, sum(opens) over (partition by transcript_id order by i rows unbounded preceding) j from cut),
c1 as (select transcript_id, j, floor(min(first_s) * 1000 + 0.5) / 1000 s, floor(arg_max(last_e, i) * 1000 + 0.5) / 1000 e, {wrap(clean("arg_max(joined, i)"))} txt, any_value(speaker) speaker from c0 group by 1, 2),
merged(transcript_id, j, s, e, txt, speaker, opens) as (
  select transcript_id, j, s, e, txt, speaker, 1 from c1 where j = 1
  union all
  select transcript_id, j, case when runt then ms else s end, e, case when runt then {wrap("joint")} else txt end, speaker, (not runt)::int from (
    select *, short and length(joint) <= 78 and e - ms <= 8 runt from (
      select k.*, m.s ms, ({words_in("k.txt")} < 3 or k.e - k.s < 1.2) and m.speaker is not distinct from k.speaker short, {both} joint from merged m join c1 k on k.transcript_id = m.transcript_id and k.j = m.j + 1))),
m0 as (select *, sum(opens) over (partition by transcript_id order by j rows unbounded preceding) g from merged),
m1 as (select transcript_id, cast(g - 1 as bigint) pos, arg_max(s, j) s, arg_max(e, j) e, arg_max(txt, j) txt, any_value(speaker) speaker from m0 group by 1, 2),
m2 as (select *, replace(txt, chr(10), ' ') flat, regexp_extract(txt, '^[^A-Za-z]*', 0) head, lead(pos) over w is null final, lag(replace(txt, chr(10), ' ')) over w before from m1 window w as (partition by transcript_id order by pos)),
cue as (select transcript_id, pos, case when before is null or regexp_matches(before, {ENDS}) then head || upper(substr(txt, length(head) + 1, 1)) || substr(txt, length(head) + 2) else txt end || case when final and not regexp_matches(flat, {ENDS}) then case when regexp_matches(flat, '[{CJK}]$') then '。' when {spaceless('flat', '$')} then '' else '.' end else '' end as text, s, e, speaker from m2)"""
