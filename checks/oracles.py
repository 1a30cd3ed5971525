"""DuckDB statements for the registered queries, over the same tables."""

from __future__ import annotations

from checks import inputs as I
from linkweave import constants as C
from linkweave.operators.lemmas import SUFFIX_RULES
from linkweave.operators.similar import LEAST, MILLI
from linkweave.operators.text_search import B, K1, SCORE_DECIMALS, parse_query
from linkweave.operators.trending import HALF_LIFE_S

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = r"\s\x{0B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
EPOCH = "timestamp '2024-01-01 00:00:00'"


def re2(pattern: str) -> str:
    return q(pattern.replace(C.WS_CLASS, WS))


def trim(x: str) -> str:
    return f"trim({x}, {q(C.WS_CHARS)})"


def kw(x: str) -> str:
    stop = ", ".join(q(w) for w in C.STOP_WORDS)
    return (
        f"list_filter(string_split_regex(lower({x}), {re2(C.KEYWORD_SEPARATORS)}), "
        f"lambda w: length(w) > 2 and w not in ({stop}) and not regexp_full_match(w, '[0-9]+'))"
    )


def distinct_list(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


# ---- inputs ----------------------------------------------------------------------------------

SEEDS = "seeds(seed_pos, tag) as (values " + ", ".join(f"({i}, {q(t)})" for i, t in enumerate(C.SEED_TAGS, 1)) + ")"

LINKS = f"""{SEEDS},
link_text as (
  select *, split_part(text, chr(10), 1) as title,
    nullif(substr(text, length(split_part(text, chr(10), 1)) + 2), '') as description,
    (select tag from seeds where seed_pos = regexp_extract(source, '([0-9]+)', 1)::int % {len(C.SEED_TAGS)} + 1) as source_tag
  from documents),
link_words as (select *, list_concat([source_tag], {kw('title')}) as words from link_text),
links as materialized (
  select doc_id + 1 as id, 'https://' || source || '.example.org/' || lang || '/' || doc_id as url,
    title, description, list_slice({distinct_list('words')}, 1, {C.MAX_TAGS}) as tags, null::varchar[] as manual_tags,
    'U' || doc_id % 50 as user_id, 'T' || doc_id % 7 as team_id, 'C' || doc_id % 20 as channel_id,
    false as is_private, {EPOCH} + to_minutes(doc_id) as created_at,
    {EPOCH} + to_minutes(doc_id) + to_hours(doc_id % 5) as updated_at
  from link_words)"""

USAGE = """usage as materialized (
  select team_id, tag as tag_name, count(*) as usage_count, max(updated_at) as last_used
  from (select team_id, updated_at, unnest(tags) as tag from links) group by 1, 2)"""


def vocab(teams: str = "select distinct team_id from usage") -> str:
    return f"""teams as ({teams}),
vocab as materialized (
  select team_id, tag, row_number() over (partition by team_id order by part, pos) as tag_rank from (
    select team_id, tag_name as tag, 0 as part,
      row_number() over (partition by team_id order by usage_count desc, tag_name) as pos
    from usage where team_id in (select team_id from teams)
    union all
    select t.team_id, s.tag, 1, s.seed_pos from teams t, seeds s
    where not exists (select 1 from usage u where u.team_id = t.team_id and u.tag_name = s.tag)))"""


ALL_TEAMS = "select distinct 'T' || user_id % 9 as team_id from events union select team_id from links"

HEAD_CASES = {
    1: """'<meta name="description" content="D ' || page_id || ' &amp; more">"""
    """<script type="application/ld+json">[{"keywords":"One, Two ,,page ' || page_id || '"},{"tags":["x"]}]</script>'""",
    2: """'<meta property=''og:description'' content=''O ' || page_id || '''><script type="application/ld+json">{"tags": ["broken"</script>'""",
    3: """'<meta name="twitter:description" content="T ' || page_id || '">'""",
    4: """'<title></title><meta property="og:title" content="OG ' || page_id || '">'""",
    5: "'<title> </title>'",
    6: """'<meta property="og:image" content="https://img.example.com/' || page_id || '.png">'""",
    7: """'<meta name="keywords" content="Alpha, beta;gamma"><meta name="article:tag" content="delta">"""
    """<meta name="tags" content="Beta,page ' || page_id || '"><script type="application/ld+json">{"keywords":["K ' || page_id"""
    """ || '", 5],"tags":["t"],"about":[{"name":"Topic"}]}</script><a class="tag" href="/x">Linked</a>'""",
}
HEADED = "headed as (select page_id, url, case " + " ".join(
    f"when page_id % 8 = {k} then {v}" for k, v in HEAD_CASES.items()
) + " else '' end || html as html from pages)"

FETCHED = """fetched as (
  select page_id, url, case when page_id % 11 = 3 then null else html end as html,
    case when page_id % 5 = 0 then 404 when page_id % 5 = 1 then 301 else 200 end as status,
    case when page_id % 3 = 0 then 'text/html; charset=utf-8' when page_id % 3 = 1 then 'text/html'
      when page_id % 2 = 0 then 'application/pdf' end as content_type,
    case when page_id % 13 = 4 then 2000000 else strlen(html) end as n_bytes
  from pages)"""

EVENTS_WITH_URLS = "evurl as (select e.*, p.url from events e join pages p on p.page_id = e.event_id % (select count(*) from pages))"

REQUESTS = f"""{EVENTS_WITH_URLS},
requests as materialized (
  select event_id as seq, url, case when event_id % 4 = 0 then [event_type] end as manual_tags,
    'U' || user_id as user_id, 'T' || user_id % 7 as team_id, 'C' || event_id % 20 as channel_id, ts as requested_at
  from evurl)"""

COMMANDS = f"""{EVENTS_WITH_URLS},
commands as (
  select event_id as seq, ts as sent_at,
    case event_type when 'click' then url || ' ' || event_type when 'view' then '  ' || url || '  '
      when 'purchase' then url || repeat(' Buy', user_id % 13)
      when 'signup' then url || ' ' || repeat('x', user_id % 60) || ' tail'
      else case user_id % 3 when 0 then '' when 1 then replace(url, '://', '//') else upper(url) end end as text,
    case when user_id % 50 = 7 then ' ' else 'U' || user_id end as user_id,
    case when user_id % 50 = 8 then '' else 'T' || user_id % 7 end as team_id,
    case when user_id % 50 = 9 then '' else 'C' || event_id % 20 end as channel_id
  from evurl),
command_parts as (select *, string_split_regex({trim('text')}, {q('[' + WS + ']+')}) as parts from commands),
parsed as materialized (
  select seq, parts[1] as url,
    case when len(list_filter(parts[2:], lambda t: t <> '')) > 0 then list_filter(parts[2:], lambda t: t <> '') end as manual_tags,
    user_id, team_id, channel_id, sent_at as requested_at
  from command_parts)"""


def valid_url(x: str) -> str:
    return (
        f"(regexp_matches({x}, '^https?://') and regexp_matches({x}, "
        "'^https?://(?:[^/\\\\?#]*@)?[^\\x00-\\x20/\\\\?#@:<>^|%\\[\\]\\x7F]+(?::[0-9]{0,5})?(?:[/\\\\?#]|$)'))"
    )


VALIDATED = f"""{COMMANDS},
checked as materialized (
  select *, case
    when coalesce(url, '') = '' then 'url: {C.MSG_URL_REQUIRED}'
    when not {valid_url('url')} then 'url: {C.MSG_URL_INVALID}'
    when {trim("coalesce(user_id, '')")} = '' then 'userId: {C.MSG_USER_REQUIRED}'
    when {trim("coalesce(channel_id, '')")} = '' then 'channelId: {C.MSG_CHANNEL_REQUIRED}'
    when len(manual_tags) > {C.MAX_MANUAL_TAGS} then 'manualTags: {C.MSG_TOO_MANY_TAGS}'
    when len(list_filter(manual_tags, lambda t: length(t) > 50)) > 0 then 'manualTags: {C.MSG_LONG_TAG}'
    end as error
  from parsed)"""

PAGE_LINKS = """stored as materialized (
  select page_id + 1 as id, url, 'Stored ' || page_id as title, null::varchar as description,
    ['stored', 'p' || page_id % 9] as tags, null::varchar[] as manual_tags, 'U' || page_id % 150 as user_id,
    'T' || page_id % 7 as team_id, 'C' || page_id % 20 as channel_id, false as is_private,
    timestamp '2023-06-01 00:00:00' as created_at, timestamp '2023-06-01 00:00:00' as updated_at
  from pages where url like 'https://%')"""


# ---- page rules ------------------------------------------------------------------------------

def meta(x: str, attr: str, name: str) -> str:
    return f"regexp_extract({x}, {re2(C.META_PATTERN.format(ws=C.WS_CLASS, attr=attr, name=name))}, 1)"


def filled(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({trim(x)}, '')" for x in xs) + ", '')"


def decoded(x: str) -> str:
    for entity, text in C.HTML_ENTITIES.items():
        x = f"replace({x}, {q(entity)}, {q(text)})"
    return x


TITLE = f"regexp_extract(html, {q(C.TITLE_PATTERN)}, 1)"
FOUND_TITLE = filled(TITLE, meta("html", "property", "og:title"))
FOUND_DESCRIPTION = filled(
    meta("html", "name", "description"), meta("html", "property", "og:description"), meta("html", "name", "twitter:description")
)
IMAGE = f"nullif({trim(meta('html', 'property', 'og:image'))}, '')"
URL_TITLE = (
    "(case when len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')) > 0 "
    "then list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')[-1] || ' - ' else '' end "
    r"|| regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\.', ''))"
)
PAGE_TITLE = f"substr(coalesce(nullif({decoded(FOUND_TITLE)}, ''), {URL_TITLE}), 1, {C.MAX_TITLE})"
PAGE_DESCRIPTION = f"substr({decoded(FOUND_DESCRIPTION)}, 1, {C.MAX_DESCRIPTION})"
OUTCOME = f"""case when status < 200 or status > 299 then 'error'
  when html is null or not contains(coalesce(content_type, ''), 'text/html') or n_bytes > {C.MAX_PAGE_BYTES} then 'fallback'
  else 'ok' end"""
FETCHED_METADATA = f"""{FETCHED},
routed as (select *, {OUTCOME} as outcome from fetched),
fetched_metadata as materialized (
  select url, outcome,
    case outcome when 'ok' then {PAGE_TITLE} when 'fallback' then {URL_TITLE} end as title,
    case outcome when 'ok' then {PAGE_DESCRIPTION} when 'fallback' then '' end as description,
    case outcome when 'error' then 'HTTP ' || status || ': ' end as message
  from routed)"""


# ---- matching --------------------------------------------------------------------------------

SEED_LEMMAS = "seed_lemmas(word, lemma) as (values " + ", ".join(
    f"({q(w)}, {q(l)})" for w, l in C.SEED_LEMMAS.items()
) + ")"
BOTH_TEXTS = kw("coalesce(title, '') || ' ' || coalesce(description, '')")
SUFFIX_LEMMAS = f"""lemma_pages as ({HEADED.split(' as (', 1)[1]},
lemma_words as (
  select distinct unnest(tags) as word from links union select unnest({BOTH_TEXTS}) from links
  union select unnest({BOTH_TEXTS}) from (select {PAGE_TITLE} as title, {PAGE_DESCRIPTION} as description from lemma_pages)),
tag_words as (select distinct unnest(tags) as word from links),
rules(ending, base) as (values {", ".join(f"({q(a)}, {q(b)})" for a, b in SUFFIX_RULES)}),
suffix_lemmas as materialized (
  select distinct word, lemma from (
    select word, substr(word, 1, length(word) - length(ending)) || base as lemma
    from lemma_words join rules on ends_with(word, ending))
  where lemma <> word and lemma <> '' and lemma in (select word from tag_words))"""
LEMMAS = f"""{SEED_LEMMAS}, {SUFFIX_LEMMAS},
lemmas as (select * from seed_lemmas union select * from suffix_lemmas)"""

TARGETS = f"""{HEADED},
targets as materialized (
  select page_id as link_id, url, {PAGE_TITLE} as title, {PAGE_DESCRIPTION} as description,
    case when page_id % 10 = 9 then null else 'T' || page_id % 7 end as team_id
  from headed)"""


def cleaned(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'))"


def lcs(a: str, b: str) -> str:
    """Fold over the characters of a; a row entry is the best common length up to that character of b."""
    return f"""list_reduce(
      list_transform(string_split({a}, ''), lambda x: list_transform(string_split({b}, ''), lambda y: (x = y)::int)),
      lambda line, hits: list_transform(hits, lambda h, j: list_max(list_transform(hits[1:j],
        lambda e, k: case when e = 1 then coalesce(line[k - 1], 0) + 1 else line[k] end))),
      list_transform(string_split({b}, ''), lambda y: 0))[-1]"""


def matching(targets: str = "targets", lemmas: str = "lemmas") -> str:
    """From (link_id, team_id, title, description) and vocab to `best`: all scored matches with a rank."""
    return f"""occ as materialized (
  select link_id, team_id, unnest(words) as keyword, generate_subscripts(words, 1) - 1 as pos
  from (select link_id, team_id, {kw("coalesce(title, '') || ' ' || coalesce(description, '')")} as words
        from {targets} where coalesce(team_id, '') <> '')),
words as materialized (select *, strip_accents(cw) as sw from (select distinct team_id, keyword, {cleaned('keyword')} as cw from occ)),
tagset as materialized (select *, strip_accents(ct) as st from (select *, {cleaned('tag')} as ct from vocab)),
word_forms as (select team_id, keyword, keyword as lemma from words
  union select w.team_id, w.keyword, l.lemma from words w join {lemmas} l on l.word = w.keyword),
tag_forms as (select team_id, tag, lower(tag) as lemma from tagset
  union select t.team_id, t.tag, l.lemma from tagset t join {lemmas} l on l.word = lower(t.tag)),
related as (select distinct team_id, keyword, tag from word_forms join tag_forms using (team_id, lemma)),
close as materialized (
  select w.team_id, w.keyword, t.tag, w.cw, t.ct from words w join tagset t using (team_id)
  where w.cw <> '' and t.ct <> '' and abs(length(w.cw) - length(t.ct)) * 200 <= 41 * (length(w.cw) + length(t.ct))
    -- without accents strings only get closer; the distance counts bytes, of which a character has up to four
    and levenshtein(w.sw, t.st) * 200 <= 41 * (length(w.cw) + length(t.ct))
      * case when strlen(w.sw) = length(w.cw) and strlen(t.st) = length(t.ct) then 1 else 4 end),
alike as materialized (
  select team_id, keyword, tag, case when cw = ct then 100
    else floor(200.0::double * {lcs('cw', 'ct')} / (length(cw) + length(ct)) + 0.5)::bigint end as similarity
  from close),
candidate_pairs as (
  select team_id, keyword, tag from related union select team_id, keyword, tag from alike where similarity >= 80
  union select w.team_id, w.keyword, t.tag from words w join tagset t using (team_id)
    where contains(t.tag, w.keyword) or (length(t.tag) > 2 and contains(w.keyword, t.tag))),
pairs as materialized (
  select c.team_id, c.keyword, c.tag, t.tag_rank, s.similarity,
    case when c.keyword = t.tag then 15 when r.tag is not null then 12 when contains(t.tag, c.keyword) then 8
      when length(t.tag) > 2 and contains(c.keyword, t.tag) then 5 else 0 end as boost
  from candidate_pairs c join tagset t on t.team_id = c.team_id and t.tag = c.tag
    left join related r on r.team_id = c.team_id and r.keyword = c.keyword and r.tag = c.tag
    left join alike s on s.team_id = c.team_id and s.keyword = c.keyword and s.tag = c.tag and s.similarity >= 80),
hits as (select o.link_id, o.pos, p.* from occ o join pairs p on p.team_id = o.team_id and p.keyword = o.keyword),
sums as (
  select link_id, tag, min(tag_rank) as tag_rank, sum(boost) as points,
    min(pos) filter (where boost > 0) as b0, min(pos) filter (where boost = 0) as f0,
    arg_min(similarity, pos) filter (where boost = 0) as f_sim,
    bool_or(boost = 15) as m1, bool_or(boost = 12) as m2, bool_or(boost = 8) as m3, bool_or(boost = 5) as m4
  from hits group by 1, 2),
used as (select *, (f0 is not null and (b0 is null or f0 < b0)) as fuzzy from sums),
scored as (
  select link_id, tag, points::double + case when fuzzy then f_sim::double / 10 else 0 end as score,
    case when fuzzy then f0 else b0 end as first_pos, fuzzy::int as phase, tag_rank,
    list_filter([case when m1 then 'perfect' end, case when m2 then 'grammatical-variation' end,
      case when m3 then 'keyword-in-tag' end, case when m4 then 'tag-in-keyword' end, case when fuzzy then 'fuzzy' end],
      lambda x: x is not null) as match_types
  from used),
ranked as (
  select *, row_number() over (partition by link_id order by score desc, first_pos, phase, tag_rank) as match_rank from scored),
best as materialized (select * from ranked where match_rank <= {C.MAX_MATCHES})"""


MATCHED = f"""{LINKS}, {USAGE}, {vocab()}, {TARGETS}, {LEMMAS}, {matching()}"""
BY_LINK = """per_link as (
  select link_id, list(tag order by match_rank) as matched, list({'tag': tag, 'score': score} order by match_rank) as matches
  from best group by link_id),
based as materialized (
  select t.*, coalesce(matched, []::varchar[]) as matched, coalesce(matches, []) as matches
  from targets t left join per_link using (link_id))"""
PROMPTED = f"{MATCHED}, {BY_LINK}"


# ---- generation ------------------------------------------------------------------------------

def prompt(template: str, tags: str | None = None) -> str:
    x = q(template)
    values = {
        "@url@": f"coalesce(nullif(url, ''), {q(C.PROMPT_UNKNOWN)})",
        "@title@": f"coalesce(nullif(title, ''), {q(C.PROMPT_UNKNOWN)})",
        "@description@": f"coalesce(nullif(description, ''), {q(C.PROMPT_NO_DESCRIPTION)})",
    }
    if tags:
        values["@tags@"] = f"array_to_string({tags}, ', ')"
    for name, value in values.items():
        x = f"replace({x}, {q(name)}, {value})"
    return x


def bracketed(x: str) -> str:
    return f"regexp_extract({x}, {q(C.JSON_ARRAY_PATTERN)}, 0)"


def json_ok(x: str) -> str:
    return f"coalesce(json_valid(nullif({bracketed(x)}, '')), false)"


def json_strings(x: str) -> str:
    return (
        f"list_transform(list_filter(try_cast(try_cast(case when {json_ok(x)} then {bracketed(x)} end as json) as json[]), "
        "lambda j: json_type(j) = 'VARCHAR'), lambda j: j ->> '$')"
    )


def reply_tags(x: str) -> str:
    cleaned_tags = (
        f"list_slice(list_filter(list_transform({json_strings(x)}, lambda t: {trim('lower(t)')}), "
        f"lambda t: t <> '' and length(t) <= {C.MAX_REPLY_TAG_LENGTH}), 1, {C.MAX_REPLY_TAGS})"
    )
    return (
        f"(case when coalesce({x}, '') = '' then null when {bracketed(x)} = '' then []::varchar[] "
        f"when {json_ok(x)} then {cleaned_tags} end)"
    )


PROTECTED = "list_filter(initial, lambda t: list_contains(matched, t))"
CANDIDATES = "list_filter(initial, lambda t: not list_contains(matched, t))"
ASKED = f"""replied as (select *, {I.first_reply()} as reply1, {I.second_reply()} as reply2 from based),
asked as materialized (select *, {reply_tags('reply1')} as initial from replied),
filtered as materialized (
  select *, case when len({CANDIDATES}) > 0 and {json_ok('reply2')} and len(list_concat({PROTECTED}, {json_strings('reply2')})) > 0
    then list_concat({PROTECTED}, {json_strings('reply2')}) else initial end as kept
  from asked)"""


def strong(scored: str, threshold: int, present: str) -> str:
    """Missing tags at or above the threshold, best first; `scored` is best first already, ties in order."""
    return (
        f"list_transform(list_filter({scored}, lambda m: m.score >= {threshold} and not list_contains({present}, m.tag)), "
        "lambda m: m.tag)"
    )


def added(current: str, extra: str) -> str:
    room = f"({C.MAX_TAGS} - len({current}))"
    keep = f"greatest(0, case when {room} >= 0 then {room} else len({extra}) + {room} end)"
    return f"list_concat({current}, list_filter({extra}, lambda t, i: i <= {keep}))"


GENERATED = f"""{ASKED},
generated as materialized (
  select *, case when kept is not null then {added('kept', strong('matches', C.HIGH_SCORE, 'kept'))} end as generated from filtered)"""


def clean_list(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda t: lower({trim('t')})), lambda t: t <> '')"


def capped(manual: str, generated: str) -> str:
    return (
        f"(case when len({manual}) > 0 then list_slice(list_concat({manual}, {generated}), 1, {C.MAX_TAGS_WITH_MANUAL}) "
        f"else {generated} end)"
    )


def final(manual: str, generated: str) -> str:
    everything = f"list_concat(coalesce({manual}, []::varchar[]), {capped(manual, generated)})"
    return clean_list(distinct_list(everything))


# ---- saving ----------------------------------------------------------------------------------

def resolved(requests: str, key: str = "url") -> str:
    """From requests with title, description, tags, manual_tags and `stored` to `after`: the table afterwards."""
    return f"""fresh as materialized (
  select r.* from {requests} r where not exists (select 1 from stored s where s.url = r.url and s.user_id = r.user_id)),
firsts as (select * from fresh qualify row_number() over (partition by {key} order by seq) = 1),
owned as (select f.{key.split(', ')[0]}, f.user_id as first_user, coalesce(s.user_id, f.user_id) as owner, s.id as stored_id, f.seq as first_seq
  from firsts f left join stored s on {' and '.join(f's.{k} = f.{k}' for k in key.split(', '))}),
others as (
  select r.* from fresh r join owned o on o.url = r.url {'and o.first_user = r.user_id' if 'user_id' in key else ''}
  where r.user_id <> o.owner qualify row_number() over (partition by {', '.join('r.' + k for k in key.split(', '))} order by r.seq desc) = 1),
batch as materialized (
  select f.seq as first_seq, f.url, f.user_id, f.team_id, f.channel_id, f.requested_at as first_at,
    coalesce(o.seq, f.seq) as content_seq
  from firsts f left join others o on {' and '.join(f'o.{k} = f.{k}' for k in key.split(', '))}),
after as materialized (
  select s.* from stored s where not exists (select 1 from batch b where {' and '.join(f'b.{k} = s.{k}' for k in key.split(', '))})
  union all
  select coalesce(s.id, (select max(id) from stored) + b.first_seq - (select min(first_seq) from batch) + 1), b.url,
    c.title, c.description, c.tags, c.manual_tags, coalesce(s.user_id, b.user_id), coalesce(s.team_id, b.team_id),
    coalesce(s.channel_id, b.channel_id), false, coalesce(s.created_at, b.first_at), c.requested_at
  from batch b join {requests} c on c.seq = b.content_seq
    left join stored s on {' and '.join(f's.{k} = b.{k}' for k in key.split(', '))})"""


SAVED_COLUMNS = (
    f"id, url, title, description, {joined('tags')} as tags, {joined('manual_tags')} as manual_tags, user_id, team_id, "
    f"channel_id, is_private, {stamp('created_at')} as created_at, {stamp('updated_at')} as updated_at"
)
CONTENT_REQUESTS = f"""{REQUESTS},
full_requests as materialized (
  select seq, url, 'Title ' || seq as title, user_id as description, [channel_id] as tags, manual_tags, user_id, team_id,
    channel_id, requested_at from requests)"""


def created(usage: str = f"{LINKS}, {USAGE}") -> str:
    """The whole save job: check, extract, match, merge replies, resolve."""
    return f"""{VALIDATED}, {PAGE_LINKS}, {usage}, {FETCHED_METADATA}, {LEMMAS},
good as materialized (
  select seq, url, manual_tags, user_id, coalesce(nullif(team_id, ''), user_id) as team_id, channel_id, requested_at
  from checked where error is null),
new_good as (select g.* from good g where not exists (select 1 from stored s where s.url = g.url and s.user_id = g.user_id)),
pairs_asked as materialized (select distinct url, team_id from new_good),
described as materialized (
  select a.team_id || chr(31) || a.url as link_id, a.url, a.team_id, m.title, m.description, m.outcome, m.message
  from pairs_asked a join fetched_metadata m using (url)),
targets as materialized (select * from described where outcome <> 'error'),
{vocab("select distinct team_id from described")}, {matching()}, {BY_LINK},
replied as (select *, {I.first_reply('team_id')} as reply1, {I.second_reply()} as reply2 from based),
asked as materialized (select *, {reply_tags('reply1')} as initial from replied),
filtered as materialized (
  select *, case when len({CANDIDATES}) > 0 and {json_ok('reply2')} and len(list_concat({PROTECTED}, {json_strings('reply2')})) > 0
    then list_concat({PROTECTED}, {json_strings('reply2')}) else initial end as kept
  from asked),
generated as materialized (
  select *, case when kept is not null then {added('kept', strong('matches', C.HIGH_SCORE, 'kept'))} end as generated from filtered),
ready as materialized (
  select g.seq, g.url, {trim("coalesce(nullif(t.title, ''), 'Untitled')")} as title, {trim("coalesce(t.description, '')")} as description,
    {final('g.manual_tags', 't.generated')} as tags, {clean_list('g.manual_tags')} as manual_tags,
    g.user_id, g.team_id, g.channel_id, g.requested_at
  from new_good g join generated t on t.url = g.url and t.team_id = g.team_id where t.generated is not null),
{resolved('ready')}"""


# ---- the statements ---------------------------------------------------------------------------

def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


oracle("parse_commands", f"with {COMMANDS} select seq, url, {joined('manual_tags')} as manual_tags, user_id, team_id, channel_id, {stamp('requested_at')} as requested_at from parsed")
oracle("check_urls", f"with {COMMANDS} select seq, {valid_url('url')} as valid from parsed")
oracle("validate_requests", f"""with {VALIDATED} select seq, split_part(error, ': ', 1) as field,
  case when error is not null then '{C.CODE_VALIDATION}' end as code, split_part(error, ': ', 2) as message,
  case when error is not null then 400::bigint end as status from checked""")
oracle("quarantine_split", f"with {VALIDATED} select seq, case when error is null then 'good' else 'rejected' end as side, split_part(error, ': ', 2) as message from checked")
oracle("clean_requests", f"""with {EVENTS_WITH_URLS}, raw as (
  select event_id as seq, user_id as u,
    case user_id % 4 when 0 then '' when 1 then ' ' when 2 then chr(9) || ' Title ' || event_id || chr(160) end as title,
    case when user_id % 3 = 0 then null else ' ' || event_type || chr(10) end as description,
    case when user_id % 5 = 0 then null else [' ' || upper(event_type) || ' ', '', ' ', event_type] end as manual_tags,
    ' U' || user_id as user_id, case when user_id % 6 = 0 then '' else 'T' || user_id % 7 end as team_id from evurl)
select seq, {trim("coalesce(nullif(title, ''), 'Untitled')")} as title, {trim("coalesce(description, '')")} as description,
  {joined(clean_list('manual_tags'))} as manual_tags, {trim('user_id')} as user_id, coalesce(nullif(team_id, ''), user_id) as team_id
from raw""")

oracle("page_titles", f"with {HEADED} select page_id, {trim(TITLE)} as title_element, {FOUND_TITLE} as title from headed")
oracle("page_descriptions", f"with {HEADED} select page_id, {FOUND_DESCRIPTION} as description from headed")
oracle("page_images", f"with {HEADED} select page_id, {IMAGE} as image_url from headed")
oracle("decode_entities", f"select page_id, md5({decoded('html')}) as digest from pages")
oracle("titles_from_urls", f"select page_id, {URL_TITLE} as title from pages")
oracle("page_outcomes", f"""with {FETCHED_METADATA} select url, outcome, title, description,
  case when outcome = 'error' then '{C.CODE_EXTERNAL}' end as code, message from fetched_metadata""")
oracle("page_metadata", f"with {HEADED} select url, 'ok' as outcome, {PAGE_TITLE} as title, {PAGE_DESCRIPTION} as description, {IMAGE} as image_url from headed")

oracle("keywords_per_document", f"select doc_id, len(w)::bigint as n_words, md5(array_to_string(w, ' ')) as digest from (select doc_id, {kw('text')} as w from documents)")
oracle("keyword_counts", f"""with {LINKS}, link_keys as (select team_id, {kw("title || ' ' || coalesce(description, '')")} as w from links),
occ as (select team_id, unnest(w) as keyword, generate_subscripts(w, 1) - 1 as pos from link_keys)
select team_id, keyword, count(*) as n, min(pos)::bigint as first_pos from occ group by 1, 2""")
oracle("team_tag_usage", f"with {LINKS}, {USAGE} select team_id, tag_name, usage_count, {stamp('last_used')} as last_used from usage")
oracle("popular_tags", f"""with {LINKS}, {USAGE} select team_id, tag_name, usage_count, position from (
  select *, row_number() over (partition by team_id order by usage_count desc, tag_name) as position from usage) where position <= {C.POPULAR_LIMIT}""")
oracle("user_tags", f"""with {LINKS}, c as (select user_id, tag, count(*) as frequency from (select user_id, unnest(tags) as tag from links) group by 1, 2)
select * from (select *, row_number() over (partition by user_id order by frequency desc, tag) as position from c) where position <= {C.SEED_TAG_LIMIT}""")
oracle("existing_tags", f"with {LINKS}, {USAGE}, {vocab(ALL_TEAMS)} select team_id, tag, tag_rank from vocab")
oracle("team_seed_tags", f"with {LINKS}, {USAGE}, {vocab(ALL_TEAMS)} select team_id, tag, tag_rank from vocab where tag_rank <= {C.SEED_TAG_LIMIT}")
oracle("tag_listing", f"with {LINKS}, {USAGE}, {vocab(ALL_TEAMS)} select team_id, tag, count(*) over (partition by team_id) as total from vocab")

oracle("suffix_lemmas", f"with {LINKS}, {SUFFIX_LEMMAS} select word, lemma from suffix_lemmas")
oracle("match_rules", f"with {MATCHED} select team_id, keyword, tag, boost::bigint as boost, case when boost = 0 then similarity end as similarity from pairs")
oracle("match_pages", f"with {MATCHED} select link_id, match_rank, tag, score, {joined('match_types')} as match_types from best")
oracle("match_report", f"with {MATCHED} select link_id, match_rank, tag, score, {joined('match_types')} as match_types from ranked")
oracle("match_documents", f"""with {LINKS}, {USAGE}, {vocab()}, targets as (select id as link_id, team_id, title, description from links), {LEMMAS},
{matching()} select link_id, match_rank, tag, score, {joined('match_types')} as match_types from best""")

CONTENT = trim("coalesce(title, '') || ' ' || coalesce(description, '')")
oracle("tag_prompts", f"""with {PROMPTED} select link_id,
  case when len(matched) > 0 then {prompt(C.TAG_PROMPT_WITH_MATCHES, 'matched')} else {prompt(C.TAG_PROMPT)} end as prompt,
  {CONTENT} as content from based""")
oracle("reply_tags", f"with {TARGETS}, r as (select link_id, {I.first_reply()} as reply1 from targets) select link_id, {joined(reply_tags('reply1'))} as tags from r")
oracle("protected_and_candidate_tags", f"with {PROMPTED}, {ASKED} select link_id, {joined(PROTECTED)} as protected, {joined(CANDIDATES)} as candidates from asked")
oracle("specificity_prompts", f"""with {PROMPTED}, {ASKED}, c as (select *, {CANDIDATES} as candidates from asked)
select link_id, {prompt(C.SPECIFICITY_PROMPT, 'candidates')} as prompt, {q(C.SPECIFICITY_MESSAGE)} || array_to_string(candidates, ', ') as content
from c where len(candidates) > 0""")
oracle("filtered_tags", f"with {PROMPTED}, {ASKED} select link_id, {joined('kept')} as tags from filtered")
PRESENT = "list_transform(range(1, link_id % 9 + 2), lambda i: 'p' || i)"
oracle("high_scoring_tags", f"with {PROMPTED}, c as (select *, {PRESENT} as present from based) select link_id, {joined(added('present', strong('matches', C.HIGH_SCORE, 'present')))} as tags from c")
oracle("merged_tags", f"""with c as (select event_id, ['alpha', event_type, 'Beta', upper(event_type[1]) || event_type[2:], 'gamma'] as generated,
  case when user_id % 11 > 0 then list_transform(range(1, user_id % 11 + 1), lambda i: upper(event_type[1]) || event_type[2:] || case when i > 1 then i::varchar else '' end) end as manual
  from events) select event_id, {joined(capped('manual', 'generated'))} as capped, {joined(final('manual', 'generated'))} as tags from c""")
oracle("generate_tags", f"with {PROMPTED}, {GENERATED} select link_id, {joined('generated')} as generated from generated")
oracle("model_replies", f"""with {TARGETS}, c as (select link_id, {CONTENT} as content from targets)
select link_id, case when content = '' then '[]' else '["' || regexp_extract(content, {q('[^' + WS + ']+')}, 0) || '"]' end as reply from c""")

LINK_VIEW = f"url, title, description, {joined('tags')} as tags, user_id, channel_id, {stamp('created_at')} as created_at, {stamp('updated_at')} as updated_at"
oracle("get_links", f"""with {LINKS} select e.event_id as id, {LINK_VIEW.replace('user_id', 'l.user_id as user_id')},
  case when l.id is null then '{C.CODE_NOT_FOUND}' end as code,
  case when l.id is null then '{C.MSG_ID}' || e.event_id || '{C.MSG_NOT_FOUND}' end as message,
  case when l.id is null then 404 else 200 end::bigint as status
from events e left join links l on l.id = e.event_id""")
oracle("find_by_url", f"""with {REQUESTS}, {PAGE_LINKS} select r.seq, s.id, s.url, s.title, s.description, {joined('s.tags')} as tags,
  {joined('s.manual_tags')} as manual_tags, s.user_id, s.team_id, s.channel_id, s.is_private, {stamp('s.created_at')} as created_at, {stamp('s.updated_at')} as updated_at
from requests r join stored s on s.url = r.url and s.user_id = r.user_id""")


def text_match(query: str) -> str:
    # a backslash before anything but %, _ or itself goes; % and _ stay wildcards
    p = f"regexp_replace({q('%' + query + '%')}, '\\\\([^%_\\\\])', '\\1', 'g')"
    tags = "'[' || array_to_string(list_transform(tags, lambda t: to_json(t)::varchar), ', ') || ']'"
    return "(" + " or ".join(f"coalesce({x} ilike {p} escape '\\', false)" for x in ("title", "description", "url", tags)) + ")"


def any_tag(tags: list[str]) -> str:
    return f"list_has_any(tags, [{', '.join(q(t) for t in tags)}])"


oracle("search_text", f"with {LINKS} select id, user_id from links where {text_match('tion_')}")
oracle("search_text_escapes", f"with {LINKS} select id, user_id from links where {text_match(chr(92) + 't%' + chr(34) + ', ' + chr(34))}")
oracle("search_tags", f"with {LINKS} select id, user_id from links where {any_tag(['react', 'python', 'with'])}")
oracle("search_pages", f"with {LINKS} select id, url, title, {joined('tags')} as tags, {stamp('created_at')} as created_at from links where {text_match('an')} order by created_at desc, id desc limit 100 offset 100")
oracle("search_totals", f"with {LINKS} select user_id, count(*) as total from links where {text_match('ing')} group by 1")
oracle("search_all_users", f"""with {LINKS} select * from (select id, {LINK_VIEW}, row_number() over (partition by user_id order by links.created_at desc, id desc) as position
from links where {text_match('er')} and {any_tag(['react', 'vue', 'python', 'go', 'api', 'the'])}) where position <= {C.SEARCH_LIMIT}""")
oracle("search_shown", f"""with {LINKS}, m as (select *, row_number() over (partition by user_id order by created_at desc, id desc) as position,
  count(*) over (partition by user_id) as total from links where {text_match('en')})
select user_id, id, title, position, least(total, {C.SEARCH_LIMIT})::bigint as found, total from m where position <= {C.SEARCH_SHOWN}""")
oracle("recent_links", f"""with {LINKS} select user_id, position, id, title, {stamp('created_at')} as created_at from (
  select *, row_number() over (partition by user_id order by created_at desc, id desc) as position from links) where position <= {C.RECENT_LIMIT}""")

oracle("upsert_links", f"""with {CONTENT_REQUESTS}, {PAGE_LINKS},
latest as (select * from full_requests qualify row_number() over (partition by url order by seq desc) = 1),
after as (
  select * from stored where url not in (select url from latest)
  union all select coalesce(s.id, (select max(id) from stored) + l.seq - (select min(seq) from latest) + 1), l.url, l.title, l.description, l.tags, l.manual_tags,
    coalesce(s.user_id, l.user_id), coalesce(s.team_id, l.team_id), coalesce(s.channel_id, l.channel_id), false, coalesce(s.created_at, l.requested_at), l.requested_at
  from latest l left join stored s on s.url = l.url)
select {SAVED_COLUMNS} from after""")
oracle("requests_for_new_links", f"with {REQUESTS}, {PAGE_LINKS} select seq, url, user_id from requests r where not exists (select 1 from stored s where s.url = r.url and s.user_id = r.user_id)")
oracle("save_batch", f"with {CONTENT_REQUESTS}, {PAGE_LINKS}, {resolved('full_requests')} select {SAVED_COLUMNS} from after")
oracle("save_batch_per_user", f"with {CONTENT_REQUESTS}, {PAGE_LINKS}, {resolved('full_requests', 'url, user_id')} select {SAVED_COLUMNS} from after")
oracle("links_after_delete", f"with {LINKS} select id, user_id, title from links l where not exists (select 1 from events e where e.event_id = l.id and 'U' || e.user_id % 50 = l.user_id)")
oracle("delete_outcomes", f"""with {LINKS}, w as (select event_id as id, 'U' || user_id % 50 as user_id from events),
o as (select w.*, exists (select 1 from links l where l.id = w.id and l.user_id = w.user_id) as deleted from w)
select id, user_id, deleted, case when not deleted then '{C.CODE_NOT_FOUND}' end as code,
  case when not deleted then '{C.MSG_ID}' || id || '{C.MSG_NOT_OWNED}' end as message, case when deleted then 200 else 404 end::bigint as status from o""")
oracle("usage_after_save", f"""with {CONTENT_REQUESTS}, {PAGE_LINKS}, {resolved('full_requests')}
select team_id, tag as tag_name, count(*) as usage_count, {stamp('max(updated_at)')} as last_used
from (select team_id, updated_at, unnest(tags) as tag from after) group by 1, 2""")
oracle("create_links", f"with {created()} select {SAVED_COLUMNS} from after")
oracle("create_links_rejected", f"""with {created()} select c.seq, c.url,
  case when c.error is not null then '{C.CODE_VALIDATION}' else '{C.CODE_EXTERNAL}' end as code,
  case when c.error is not null then split_part(c.error, ': ', 2) else coalesce(d.message, '{C.MSG_TAGS_FAILED}') end as message,
  case when c.error is not null then 400 else 502 end::bigint as status
from checked c left join new_good g on g.seq = c.seq left join described d on d.url = g.url and d.team_id = g.team_id
left join generated t on t.link_id = d.link_id
where c.error is not null or (d.link_id is not null and t.generated is null)""")
oracle("create_links_usage", f"""with {created()} select team_id, tag as tag_name, count(*) as usage_count, {stamp('max(updated_at)')} as last_used
from (select team_id, updated_at, unnest(tags) as tag from after) group by 1, 2""")
oracle("create_links_repeated_pages", ORACLES["create_links"])
oracle("create_links_repeated_requests", f"""with {created()} select r.seq, r.url, r.user_id from ready r join owned o on o.url = r.url
where o.stored_id is null and r.user_id = o.first_user and r.seq > o.first_seq""")
oracle("stored_usage", ORACLES["usage_after_save"])
oracle("store_per_user", ORACLES["save_batch_per_user"].replace("select id, url, title", "select url, title"))
oracle("usage_after_delete", f"""with {LINKS}, after as (
  select * from links l where not exists (select 1 from events e where e.event_id = l.id and 'U' || e.user_id % 50 = l.user_id))
select team_id, tag as tag_name, count(*) as usage_count, {stamp('max(updated_at)')} as last_used
from (select team_id, updated_at, unnest(tags) as tag from after) group by 1, 2""")
oracle("read_links", f"with {LINKS} select id, url, title, {joined('tags')} as tags, {stamp('created_at')} as created_at from links")
oracle("seed_tags", f"""with {LINKS}, used as (select unnest(tags) as tag from links)
select s.seed_pos::bigint as tag_rank, s.tag, (select count(*) from used u where u.tag = s.tag) as n from seeds s""")
oracle("long_page_titles", f"""with words as (select url, regexp_replace(html, '[<>&"'']|\\s+', ' ', 'g') as words from pages),
long as (select url, '<title>T' || words || '</title><meta name="description" content="D' || words || '">' as html from words)
select url, {PAGE_TITLE} as title, {PAGE_DESCRIPTION} as description from long""")
oracle("find_by_id", f"with {LINKS} select id, url, title from links where id = (select max(id) // 2 from links)")
oracle("search_one_user", f"""with {LINKS} select id, url, title from links where user_id = 'U7' and {text_match('an')}
and {any_tag(C.SEED_TAGS[:30])} order by created_at desc, id desc limit 20 offset 1""")
oracle("recent_of_one_user", f"with {LINKS} select id, url, {stamp('created_at')} as created_at from links where user_id = 'U7' order by links.created_at desc, id desc limit 5")
oracle("create_links_unchecked", f"""with {COMMANDS} select seq, url, '{C.CODE_VALIDATION}' as code,
  case when coalesce(url, '') = '' then '{C.MSG_URL_REQUIRED}' else '{C.MSG_URL_INVALID}' end as message
from parsed where coalesce(url, '') = '' or not {valid_url('url')}""")
STORED_USAGE = f"{LINKS}, {USAGE.replace('from links', 'from stored')}"
oracle("stream_create_links", f"with {created(STORED_USAGE)} select {SAVED_COLUMNS} from after")
oracle("stream_tag_usage", ORACLES["team_tag_usage"])


# ---- tags declared by pages -----------------------------------------------------------------

def listed(name: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex({meta('html', 'name', name)}, '[,;]'), lambda t: lower({trim('t')})), "
        f"lambda t: t <> '' and length(t) <= {C.MAX_PAGE_TAG_LENGTH})"
    )


ARTICLE = (
    f"list_filter(list_transform(regexp_extract_all(html, {re2(C.META_PATTERN.format(ws=C.WS_CLASS, attr='name', name='article:tag'))}, 1), "
    f"lambda t: lower({trim('t')})), lambda t: t <> '' and length(t) <= {C.MAX_PAGE_TAG_LENGTH})"
)
LD = f"regexp_extract_all(html, {re2(C.JSON_LD_PATTERN.format(ws=C.WS_CLASS))}, 1)"
LD_ITEMS = f"""flatten(list_transform(list_filter({LD}, lambda b: json_valid(b)),
  lambda b: case when json_type(b) = 'ARRAY' then try_cast(b::json as json[]) else [b::json] end))"""


def json_texts(item: str, member: str) -> str:
    return (
        f"list_transform(list_filter(coalesce(try_cast(json_extract({item}, '$.{member}') as json[]), []), "
        "lambda j: json_type(j) = 'VARCHAR'), lambda j: j ->> '$')"
    )


LD_TAGS = f"""list_transform(list_filter(flatten(list_transform({LD_ITEMS}, lambda i: list_concat(
  case when json_type(i, '$.keywords') = 'VARCHAR' then list_transform(string_split(i ->> '$.keywords', ','), lambda t: {trim('t')})
    else {json_texts('i', 'keywords')} end,
  {json_texts('i', 'tags')},
  list_filter(list_transform(coalesce(try_cast(json_extract(i, '$.about') as json[]), []), lambda j: j ->> '$.name'), lambda t: t is not null)))),
  lambda t: t <> '' and length(t) <= {C.MAX_PAGE_TAG_LENGTH}), lambda t: lower(t))"""
TAXONOMY = (
    f"list_filter(list_transform(regexp_extract_all(html, {q(C.TAXONOMY_LINK_PATTERN)}, 1), lambda t: lower({trim('t')})), "
    "lambda t: length(t) between 2 and 20 and not contains(t, ' '))"
)
oracle("page_meta_keywords", f"with {HEADED} select page_id, {joined(listed('keywords'))} as tags from headed")
oracle("page_article_tags", f"with {HEADED} select page_id, {joined(ARTICLE)} as tags from headed")
oracle("page_cms_tags", f"with {HEADED} select page_id, {joined(listed('tags'))} as tags from headed")
oracle("page_json_ld_tags", f"with {HEADED} select page_id, {joined(LD_TAGS)} as tags from headed")
oracle("page_taxonomy_links", f"with {HEADED} select page_id, {joined(TAXONOMY)} as tags from headed")
ALL_FOUND = f"""found as materialized (select page_id, url, list_concat(list_concat(list_concat({listed('keywords')}, {ARTICLE}), {listed('tags')}),
  list_concat({LD_TAGS}, {TAXONOMY})) as f from headed)"""
PAGE_TAGS = f"list_slice({distinct_list('f')}, 1, {C.MAX_PAGE_TAGS})"
oracle("page_tags", f"with {HEADED}, {ALL_FOUND} select page_id, {joined(PAGE_TAGS)} as tags from found")


def page_score(tag: str, title: str, description: str) -> str:
    content = f"lower(coalesce({title}, '') || ' ' || coalesce({description}, ''))"
    name = f"lower({trim(tag)})"
    return f"""(5 + case when contains({content}, {name}) then 8 else 0 end
      + 2 * len(list_filter(string_split_regex({name}, {q('[' + WS + chr(92) + '-_]+')}), lambda w: list_contains(string_split_regex({content}, {q('[' + WS + ']+')}), w)))
      - case when length({name}) > 20 then 3 else 0 end - case when regexp_matches({name}, '[0-9]') then 2 else 0 end
      + case when not contains({name}, ' ') and length({name}) > 2 then 1 else 0 end)::bigint"""


oracle("page_tag_scores", f"""with {LINKS}, t as (select id, title, description, unnest(tags) as tag from links),
s as (select id, tag, {page_score('tag', 'title', 'description')}::double as score from t)
select * from s where score >= {C.MIN_PAGE_TAG_SCORE}""")
oracle("include_page_tags", f"""with {PROMPTED}, {ALL_FOUND},
page_scored as (
  select link_id, list({{'tag': tag, 'score': score}} order by score desc, pos) as page_scores from (
    select b.link_id, p.tag, p.pos, {page_score('p.tag', 'b.title', 'b.description')} as score
    from based b join (select page_id, unnest({PAGE_TAGS}) as tag, generate_subscripts({PAGE_TAGS}, 1) as pos from found) p on p.page_id = b.link_id)
  group by 1),
c as (select b.*, {PRESENT} as present, coalesce(page_scores, []) as page_scores from based b left join page_scored using (link_id)),
d as (select *, {strong('matches', C.HIGH_SCORE, 'present')} as s1 from c),
e as (select *, {strong('page_scores', C.HIGH_PAGE_TAG_SCORE, 'list_concat(present, s1)')} as s2 from d),
f as (select *, list_concat(s1, s2) as extra from e)
select link_id, {joined(added('present', 'extra'))} as tags from f""")


WITH_PAGE_TAGS = f"""{ALL_FOUND},
page_scored as (
  select link_id, list({{'tag': tag, 'score': score}} order by score desc, pos) as page_scores from (
    select b.link_id, p.tag, p.pos, {page_score('p.tag', 'b.title', 'b.description')} as score
    from based b join (select url, unnest({PAGE_TAGS}) as tag, generate_subscripts({PAGE_TAGS}, 1) as pos from found) p on p.url = b.url
    where b.outcome = 'ok')
  group by 1),
merging as (select f.*, coalesce(page_scores, []) as page_scores from filtered f left join page_scored using (link_id)),
merging1 as (select *, {strong('matches', C.HIGH_SCORE, 'kept')} as s1 from merging),
merging2 as (select *, {strong('page_scores', C.HIGH_PAGE_TAG_SCORE, 'list_concat(kept, s1)')} as s2 from merging1),
generated as materialized (
  select *, case when kept is not null then {added('kept', 'list_concat(s1, s2)')} end as generated from merging2),
ready as"""


def created_with_page_tags() -> str:
    """The save job over pages with heads, their own tags included."""
    sql = created().replace(FETCHED, f"{HEADED}, {FETCHED.replace('from pages)', 'from headed)')}")
    before, after = sql.split("generated as materialized (", 1)
    return before + WITH_PAGE_TAGS + after.split("ready as", 1)[1]


oracle("create_links_with_page_tags", f"with {created_with_page_tags()} select {SAVED_COLUMNS} from after")


# ---- indexes ---------------------------------------------------------------------------------

EDITED = f"""{LINKS},
edited as materialized (
  select id, url, case when exists (select 1 from events e where e.event_id = l.id and event_type = 'purchase')
    then 'Renamed ' || id || ' ' || title else title end as title, description, tags, user_id
  from links l where not exists (select 1 from events e where e.event_id = l.id and event_type = 'signup'))"""
WORDS = """words as materialized (
  select id, user_id, unnest(ws) as term, generate_subscripts(ws, 1) as pos, len(ws) as size from (
    select id, user_id, regexp_extract_all(lower(title || ' ' || coalesce(description, '')), '[\\p{L}\\p{N}]+') as ws from edited))"""


def found_words(query: str) -> str:
    """Links that hold each phrase of a query at some place."""
    held = []
    for group in parse_query(query):
        tables = ", ".join(f"words w{i}" for i in range(len(group)))
        chain = " and ".join([f"w{i}.term = {q(w)}" for i, w in enumerate(group)] + [f"w{i}.id = w0.id and w{i}.pos = w0.pos + {i}" for i in range(1, len(group))])
        held.append(f"select w0.id from {tables} where {chain}")
    where = " and ".join(f"id in ({h})" for h in held) or "false"
    return f"select {q(query)} as query, id, user_id from edited where {where}"


oracle("full_text_search", f"with {EDITED}, {WORDS} " + " union all ".join(found_words(text) for text in I.TEXT_QUERIES))


oracle("substring_search", f"with {EDITED} " + " union all ".join(
    f"select {q(text)} as query, id, user_id from edited where {text_match(text)}" for text in I.SUBSTRINGS))
oracle("relevance_search", f"""with {EDITED}, {WORDS},
sizes as (select count(*) as n, (select count(*) from words) / count(*) as average from edited),
tf as (select user_id, id, term, count(*) as n, any_value(size) as size from words
  where term in ({', '.join(q(w) for g in parse_query(I.RELEVANCE_QUERY) for w in g)}) group by all),
df as (select term, count(*) as df from tf group by 1),
scores as (
  select user_id, id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf.n * {K1 + 1} / (tf.n + {K1} * ({1 - B} + {B} * size / average))), {SCORE_DECIMALS}) as score
  from tf join df using (term), sizes s group by 1, 2),
ranked as (select *, row_number() over (partition by user_id order by score desc, id) as rank from scores)
select user_id, rank, id, score from ranked where rank <= 5""")


# ---- similar links, trends, renamed tags -----------------------------------------------------

oracle("similar_links", f"""with {LINKS},
sets as materialized (select team_id, min(id) as id, tags, list(id) as ids from (
  select team_id, id, list_sort(tags) as tags from links where len(tags) > 0) group by team_id, tags),
weights as materialized (
  select tag, round({MILLI} * ln(1 + (select count(*) from links where len(tags) > 0) / count(*)))::bigint as weight
  from (select unnest(tags) as tag from links) group by tag),
items as materialized (select team_id, id, unnest(tags) as tag from sets),
sized as (select team_id, id, sum(weight) as total from items join weights using (tag) group by all),
common as (
  select a.team_id, a.id, b.id as other_id, sum(weight) as mutual
  from items a join items b on a.team_id = b.team_id and a.tag = b.tag and a.id < b.id join weights w on w.tag = a.tag group by all)
select c.team_id, c.id, other_id, round(mutual / (x.total + y.total - mutual), 6) as similarity
from common c join sized x on x.id = c.id join sized y on y.id = other_id
where mutual * {LEAST[1]} >= (x.total + y.total - mutual) * {LEAST[0]}
union all
select team_id, id, member, 1.0 from (select team_id, id, unnest(ids) as member from sets) where member <> id""")
oracle("trending_tags", f"""with {LINKS},
now as (select epoch(max(updated_at)) + 86400 as instant from links),
scores as (
  select team_id, tag, round(sum(pow(2.0, (epoch(updated_at) - instant) / {HALF_LIFE_S})), 6) as score
  from (select team_id, updated_at, unnest(tags) as tag from links), now group by 1, 2),
ranked as (select *, row_number() over (partition by team_id order by score desc, tag) as position from scores where score > 0)
select team_id, position, tag, score from ranked where position <= 10""")
RENAMED = f"""{LINKS},
targets as (select s.tag, coalesce((select max(t.seed_pos) from seeds t where t.seed_pos <= s.seed_pos and (t.seed_pos = 1 or t.seed_pos % 7 = 0)), s.seed_pos) as end_pos
  from seeds s where s.seed_pos % 7 <> 0 and s.seed_pos <> 1),
closed as materialized (select t.tag, s.tag as target from targets t join seeds s on s.seed_pos = end_pos),
renamed as materialized (
  select id, team_id, updated_at, list(tag order by pos) as tags from (
    select id, team_id, updated_at, coalesce(target, l.tag) as tag, min(pos) as pos
    from (select id, team_id, updated_at, unnest(tags) as tag, generate_subscripts(tags, 1) as pos from links) l left join closed c on c.tag = l.tag
    group by 1, 2, 3, 4) group by 1, 2, 3)"""
oracle("renamed_tags", f"with {RENAMED} select id, team_id, {joined('tags')} as tags from renamed union all select id, team_id, '' from links where len(tags) = 0")
oracle("usage_after_rename", f"""with {RENAMED} select team_id, tag as tag_name, count(*) as usage_count, {stamp('max(updated_at)')} as last_used
from (select team_id, updated_at, unnest(tags) as tag from renamed) group by 1, 2""")
