"""DuckDB SQL for the registered queries. Common table expressions are named parts; `_sql` adds those that a query needs."""

from __future__ import annotations

import re

from lexmill.functions import rules as R
from lexmill.profile import BACKOFF, BOS, CORROBORATION, EOS, HELDOUT_EVERY, MAX_CHARS, MIN_CHARS, MIN_FREQ, MIN_SOURCES, MIN_WORDS, SHADOW_RATIO, SHADOW_VARIANTS, SOLO_FREQ, YAKUT
from lexmill.sources.demo import PROJECT

P = YAKUT


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _translate(x: str, pair: tuple[str, str]) -> str:
    return f"translate({x}, {_q(pair[0])}, {_q(pair[1])})"


def _list(items) -> str:
    return "[" + ", ".join(_q(x) for x in items) + "]"


TOKEN, CYR = _q(P.token), _q(f"^{P.letters}")


def _words(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, {TOKEN}, 0), lambda t: regexp_matches(t, {CYR}))"


def _lower_words(x: str) -> str:
    return f"list_transform({_words(x)}, lambda t: lower(t))"


def _only(x: str, letters: str) -> str:
    return f"length(regexp_replace(lower({x}), {_q(f'[^{letters}]')}, '', 'g'))"


def _share(x: str, letters: str) -> str:
    n = _only(x, "\\p{L}")
    return f"CASE WHEN {n} > 0 THEN {_only(x, letters)} / {n} ELSE 0.0 END"


def _harmonic(w: str) -> str:
    n = f"regexp_extract_all(p, {_q(P.nuclei)}, 0)"
    bad = f"list_filter(range(1, len({n})), lambda i: NOT list_contains({_list(P.follows)}, {n}[i] || '→' || {n}[i + 1]))"
    return f"(regexp_matches(lower({w}), '[{P.loan_letters}]') OR len(list_filter(string_split(lower({w}), '-'), lambda p: len({bad}) > 0)) = 0)"


_COLLAPSED = "replace(replace(lower(form), 'дь', 'д'), 'нь', 'н')"
_NATIVE = f"NOT regexp_matches(lower(form), '[{P.loan_letters}]')"
_TAIL = f"regexp_extract(p, '[{P.consonants}]{{2,}}$', 0)"
RULE = {
    "harmony": f"NOT {_harmonic('form')}",
    "vowel_pairs": f"{_NATIVE} AND len(list_filter(string_split(lower(form), '-'), lambda p: len(list_filter(regexp_extract_all(p, '[{P.short_vowels}][{P.short_vowels}]', 0), lambda x: NOT list_contains({_list([*P.long_vowels, *P.diphthongs])}, x))) > 0)) > 0",
    "initial": f"regexp_matches('-' || lower(form), '-[{P.no_initial}]')",
    "final": f"{_NATIVE} AND regexp_matches(lower(form) || '-', '[{P.no_final}]-')",
    "clusters": f"{_NATIVE} AND regexp_matches({_COLLAPSED}, '[{P.consonants}]{{3,}}')",
    "final_cluster": f"{_NATIVE} AND len(list_filter(string_split({_COLLAPSED}, '-'), lambda p: length({_TAIL}) >= 2 AND NOT list_contains({_list(P.final_clusters)}, right({_TAIL}, 2)))) > 0",
    "soft_sign": f"{_NATIVE} AND regexp_matches(lower(form), '(^|[^дн])ь')",
    "triple_letter": "(" + " OR ".join(f"contains(lower(form), '{v * 3}')" for v in P.short_vowels) + ")",
}


def _known(name: str, forms: str, use_tail: bool = True, use_hyphen: bool = True, grammar: bool = False) -> str:
    """CTEs that end in one called `name`: form, ok, reason, freq for the forms of the CTE `forms`."""
    discord = f"AND {_harmonic('l.form')}" if grammar else ""
    wrong = f"WHEN {str(use_tail).lower()} AND k.kind = 'tail' AND k.freq_other >= {CORROBORATION} THEN 'tail-disharmonic'" if grammar else ""
    reason = f"""CASE WHEN d.shadow IS NOT NULL THEN 'shadow' WHEN k.kind = 'core' THEN 'core'
      WHEN {str(use_tail).lower()} AND k.kind = 'tail' AND k.freq_other >= {CORROBORATION} {discord} THEN 'tail-corroborated' {wrong}
      WHEN {str(use_tail).lower()} AND k.kind = 'tail' THEN 'tail-unconfirmed' ELSE 'unknown' END"""
    judged = lambda of: f"SELECT l.form, {reason} AS reason, k.freq FROM (SELECT DISTINCT form FROM {of}) l LEFT JOIN alive k ON k.form = l.form LEFT JOIN dark d ON d.shadow = l.form"
    parts = "list_filter(string_split(translate(form, '’''', '--'), '-'), lambda p: p <> '')"
    return f"""{name}_alone AS ({judged(forms)}),
{name}_pairs AS (SELECT form AS whole, unnest({parts}) AS form FROM (SELECT DISTINCT form FROM {forms}) WHERE len({parts}) > 1),
{name}_parts AS ({judged(f'{name}_pairs')}),
{name}_good AS (SELECT whole FROM {name}_pairs JOIN {name}_parts USING (form) WHERE {str(use_hyphen).lower()} GROUP BY whole HAVING bool_and(reason IN ('core', 'tail-corroborated'))),
{name} AS (SELECT form, reason IN ('core', 'hyphen-parts', 'tail-corroborated') AS ok, reason, CAST(CASE WHEN reason IN ('hyphen-parts', 'shadow', 'unknown') THEN 0 ELSE freq END AS BIGINT) AS freq FROM (
  SELECT form, freq, CASE WHEN reason NOT IN ('shadow', 'core') AND form IN (SELECT whole FROM {name}_good) THEN 'hyphen-parts' ELSE reason END AS reason FROM {name}_alone))"""


_SHADOW_CHOICES = "list_transform(string_split(form, ''), lambda c: CASE c " + " ".join(f"WHEN '{k}' THEN {_list([k, *v])}" for k, v in P.shadows.items()) + " ELSE [c] END)"
_SHADOW_SIZE = " * ".join(f"pow({len(v) + 1}, length(form) - length(replace(form, '{k}', '')))" for k, v in P.shadows.items())
_PRODUCT = "list_reduce({0}, lambda a, b: flatten(list_transform(a, lambda x: list_transform(b, lambda y: x || y))))"
_LESS = lambda n: f"CAST(round({n}, 9) AS DOUBLE)"
_KEYS = P.restore[0]
_CORE_SHARE = "coalesce(sum(n) FILTER (kind = 'core'), 0) / sum(n)"
_EDITED = "AND tier = 'edited'"
_CHANGED = "range(1, length(word) + 1), lambda i: substr(word, i, 1) <> substr(form, i, 1)"

PARTS = {
    "doc": f"""doc AS (SELECT doc_id, source, CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 'edited' WHEN 1 THEN 'web' ELSE 'ocr' END AS tier,
  CASE WHEN doc_id % 10 = 0 THEN {_translate('clean', P.plain['ru'])} ELSE clean END AS text, clean FROM (SELECT doc_id, source, {_translate('text', PROJECT)} AS clean FROM documents))""",
    "sentence": """sentence AS (SELECT doc_id, source, tier, CAST(i - 1 AS BIGINT) AS sent_idx, trim(regexp_replace(ls[i], '\\s+', ' ', 'g')) AS text
  FROM (SELECT doc_id, source, tier, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM doc) WHERE trim(regexp_replace(ls[i], '\\s+', ' ', 'g')) <> '')""",
    "counts": f"counts AS (SELECT source, tier, form, count(*) AS n FROM (SELECT source, tier, unnest({_lower_words('text')}) AS form FROM doc) GROUP BY ALL)",
    "lexicon": f"""lexicon AS (SELECT *, CASE WHEN freq >= {MIN_FREQ} AND n_sources >= {MIN_SOURCES} OR freq >= {SOLO_FREQ} THEN 'core' WHEN freq > 0 THEN 'tail' ELSE 'other' END AS kind FROM (
  SELECT form, CAST(coalesce(sum(n) FILTER (tier = 'edited'), 0) AS BIGINT) AS freq, count(*) FILTER (tier = 'edited') AS n_sources, CAST(coalesce(sum(n) FILTER (tier <> 'edited'), 0) AS BIGINT) AS freq_other FROM counts GROUP BY form))""",
    "shadow": f"""variant AS (SELECT form AS origin, freq AS freq_origin, unnest({_PRODUCT.format(_SHADOW_CHOICES)}) AS shadow FROM lexicon WHERE kind = 'core' AND regexp_matches(form, '[{P.special}]') AND {_SHADOW_SIZE} <= {SHADOW_VARIANTS}),
shadow AS (SELECT shadow, k.freq AS freq_shadow, k.kind AS found_in, origin, freq_origin, freq_origin / greatest(k.freq, 1) AS ratio, CAST(freq_origin / greatest(k.freq, 1) >= {SHADOW_RATIO} AS BIGINT) AS demote
  FROM variant v JOIN lexicon k ON k.form = v.shadow AND (k.kind = 'core' OR k.kind = 'tail' AND k.freq_other >= {CORROBORATION}) WHERE shadow <> origin
  QUALIFY row_number() OVER (PARTITION BY shadow ORDER BY freq_origin DESC, origin) = 1)""",
    "alive": "dark AS (SELECT shadow, origin FROM shadow WHERE demote = 1),\nalive AS (SELECT * FROM lexicon WHERE form NOT IN (SELECT shadow FROM dark)),\ncore AS (SELECT form, freq FROM alive WHERE kind = 'core')",
    "verdict": _known("verdict", "counts"),
    "restored": f"""restored AS (
  SELECT word, form, freq FROM (SELECT w.form AS word, {_translate('w.form', P.restore)} AS key, c.form, c.freq FROM (SELECT form FROM verdict WHERE NOT ok) w JOIN core c ON {_translate('w.form', P.restore)} = {_translate('c.form', P.restore)} AND w.form <> c.form AND length(w.form) = length(c.form))
  WHERE len(list_filter({_CHANGED} AND substr(key, i, 1) <> substr(form, i, 1))) = 0
    AND (length(regexp_replace(word, '[^{_KEYS}]', '', 'g')) <= 12 OR len(list_filter({_CHANGED} AND NOT (substr(word, i, 1) IN ('г', 'о', 'у') AND length(regexp_replace(substr(word, i), '[^гоу]', '', 'g')) <= 12))) = 0)
  UNION ALL SELECT w.form, c.form, c.freq FROM verdict w JOIN core c ON c.form = replace(w.form, 'нг', 'ҥ') WHERE NOT w.ok AND contains(w.form, 'нг')),
priced AS (SELECT *, CAST(35 * greatest(1, len(list_filter(range(1, least(length(word), length(form)) + 1), lambda i: substr(word, i, 1) <> substr(form, i, 1)))) AS BIGINT) AS cost FROM restored)""",
    "best": f"""offered AS (SELECT word, form, freq, cost, 1 AS stage FROM priced
  UNION ALL SELECT v.form, d.origin, coalesce(c.freq, 1), 1, 0 FROM verdict v JOIN dark d ON d.shadow = v.form LEFT JOIN core c ON c.form = d.origin WHERE NOT v.ok AND NOT EXISTS (SELECT 1 FROM priced p WHERE p.word = v.form AND p.form = d.origin)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY cost - 12 * log10(greatest(freq, 1)), stage, cost, freq DESC, form) AS rank FROM offered),
best AS (SELECT word, max(form) FILTER (rank = 1) AS form, list(form ORDER BY rank) FILTER (rank <= 5) AS forms FROM ranked GROUP BY word),
piece AS (SELECT doc_id, pos, p, CAST(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_at, regexp_matches(p, {CYR}) AS is_word
  FROM (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS p FROM (SELECT doc_id, regexp_extract_all(text, {_q(f'(?s:{P.token}|.)')}, 0) AS ps FROM doc)))""",
    "pair": f"""pair AS (SELECT id, task, CAST(i - 1 AS BIGINT) AS word_idx, a[i] AS before, b[i] AS after FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (
  SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'denorm_full' ELSE 'clean' END AS task, {_words('text')} AS a, {_words('clean')} AS b FROM doc) WHERE len(a) = len(b)))""",
    "bigram": f"""seq AS (SELECT ['{BOS}'] || w || ['{EOS}'] AS w FROM (SELECT {_lower_words('text')} AS w FROM sentence) WHERE len(w) > 0),
uni AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM seq) GROUP BY word),
allpair AS (SELECT w1, w2, count(*) AS n FROM (SELECT w[i] AS w1, w[i + 1] AS w2 FROM (SELECT w, unnest(range(1, len(w))) AS i FROM seq)) GROUP BY ALL),
voc AS (SELECT form FROM lexicon WHERE kind = 'core' UNION ALL SELECT '{BOS}' UNION ALL SELECT '{EOS}'),
bi AS (SELECT * FROM allpair WHERE n >= 3 AND w1 IN (SELECT form FROM voc) AND w2 IN (SELECT form FROM voc))""",
    "context": f"context AS (SELECT doc_id, CAST(i - 2 AS BIGINT) AS word_idx, w[i - 1] AS w_left, w[i] AS word, w[i + 1] AS w_right FROM (SELECT doc_id, w, unnest(range(2, len(w))) AS i FROM (SELECT doc_id, ['{BOS}'] || {_lower_words('text')} || ['{EOS}'] AS w FROM doc)))",
}
_EITHER = "form"
for _k, _v in P.shadows.items():
    _EITHER = f"replace({_EITHER}, '{_k}', '(?:{'|'.join((_k, *_v))})')"
_PLAIN = "regexp_replace(translate(form, 'ҥцҕөүьһh', 'ннгоуссс'), 'нг+', 'н', 'g')"
#: `shadow` over origins of any number of distortions: forms meet by a key that distortion leaves alone and are matched then.
ALL_SHADOWS = f"""variant AS (SELECT form AS origin, freq AS freq_origin, {_PLAIN} AS k, {_EITHER} AS pattern FROM lexicon WHERE kind = 'core' AND regexp_matches(form, '[{P.special}]')),
keyed AS (SELECT form, freq, kind, {_PLAIN} AS k FROM lexicon WHERE kind = 'core' OR kind = 'tail' AND freq_other >= {CORROBORATION}),
shadow AS (SELECT form AS shadow, freq AS freq_shadow, kind AS found_in, origin, freq_origin, freq_origin / greatest(freq, 1) AS ratio, CAST(freq_origin / greatest(freq, 1) >= {SHADOW_RATIO} AS BIGINT) AS demote
  FROM variant v JOIN keyed USING (k) WHERE form <> origin AND regexp_full_match(form, pattern)
  QUALIFY row_number() OVER (PARTITION BY form ORDER BY freq_origin DESC, origin) = 1)"""
#: What each part is made from.
NEEDS = {"sentence": "doc", "counts": "doc", "lexicon": "counts", "shadow": "lexicon", "alive": "shadow", "verdict": "alive", "restored": "verdict", "best": "restored", "pair": "doc", "bigram": "sentence lexicon", "context": "doc"}


def _sql(needs: str, body: str, *more: str, **instead: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, "").split():
            add(x)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    # each part is made once, whatever reads it
    parts = re.sub(r"(?m)^(\w+) AS \(", r"\1 AS MATERIALIZED (", ",\n".join([*[instead.get(x, PARTS[x]) for x in order], *more]))
    return f"WITH {parts}\n{body}"


def _miss(of: str) -> str:
    return f"counts WHERE form NOT IN (SELECT form FROM lexicon WHERE kind = 'core') {of}"


_METRICS = """SELECT task, items, words, tp, fp, fn, found, missed, false_flags, clean, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / greatest(p + r, 1e-9), 9) AS f1,
  round(found / greatest(found + missed, 1), 9) AS detection_recall, round(false_flags / greatest(clean, 1), 9) AS fpr FROM (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM (
  SELECT task, count(DISTINCT id) AS items, count(*) AS words, count(*) FILTER (made AND gold AND good) AS tp, count(*) FILTER (made AND NOT (gold AND good)) AS fp, count(*) FILTER (gold AND NOT (made AND good)) AS fn,
    count(*) FILTER (flagged AND gold) AS found, count(*) FILTER (NOT flagged AND gold) AS missed, count(*) FILTER (flagged AND NOT gold) AS false_flags, count(*) FILTER (NOT gold) AS clean
  FROM (SELECT p.id, p.task, lower(before) <> lower(after) AS gold, b.form IS NOT NULL AS made, coalesce(lower(b.form) = lower(after), false) AS good, {flag} AS flagged
    FROM pair p JOIN verdict v ON v.form = lower(p.before) LEFT JOIN best b ON b.word = v.form AND NOT v.ok) GROUP BY task))"""
_PROPOSED = """proposed AS (SELECT *, before_low <> after_low AS gold, CASE WHEN before_low <> after_low OR n % 50 = 7 THEN n / 1000 END AS confidence, before_low <> after_low AND CASE WHEN before_low <> after_low AND n % 5 > 0 THEN true ELSE lower(reverse(before)) = after_low END AS good
  FROM (SELECT *, lower(before) AS before_low, lower(after) AS after_low, (id * 7919 + word_idx * 10007) % 1000 AS n FROM pair))"""
_SWEEP = """SELECT task, threshold, items, words, tp, fp, fn, found, missed, false_flags, clean, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / greatest(p + r, 1e-9), 9) AS f1, round(found / greatest(found + missed, 1), 9) AS detection_recall, round(false_flags / greatest(clean, 1), 9) AS fpr
  FROM (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM (
  SELECT task, threshold, count(DISTINCT id) AS items, count(*) AS words, count(*) FILTER (made AND good) AS tp, count(*) FILTER (made AND NOT good) AS fp, count(*) FILTER (gold AND NOT (made AND good)) AS fn, count(*) FILTER (made AND gold) AS found, count(*) FILTER (gold AND NOT made) AS missed, count(*) FILTER (made AND NOT gold) AS false_flags, count(*) FILTER (NOT gold) AS clean
  FROM (SELECT *, coalesce(confidence >= threshold, false) AS made FROM proposed, (SELECT CAST(unnest([0.3, 0.5, 0.7, 0.9, 0.95, 0.99]) AS DOUBLE) AS threshold)) GROUP BY task, threshold))"""
_CASED = "CASE WHEN p = lower(p) THEN {0} WHEN p = upper(p) THEN upper({0}) WHEN left(p, 1) = upper(left(p, 1)) AND left(p, 1) <> lower(left(p, 1)) THEN upper(left({0}, 1)) || lower(substr({0}, 2)) ELSE {0} END"
_CONFIGS = {"core": {"use_tail": False, "use_hyphen": False}, "hyphen": {"use_tail": False}, "tail": {}}
_CORRECTIONS = f"""SELECT doc_id, end_at - length(p) AS start_at, end_at, p AS before, {_CASED.format('b.form')} AS after, v.reason AS source, array_to_string(list_transform(b.forms, lambda f: {_CASED.format('f')}), ' ') AS alternatives
  FROM piece JOIN verdict v ON is_word AND v.form = lower(p) AND NOT v.ok JOIN best b ON b.word = v.form"""

_KEPT = f"""SELECT doc_id, source, sent_idx, text FROM (SELECT *, {_lower_words('text')} AS w FROM sentence) WHERE length(text) BETWEEN {MIN_CHARS} AND {MAX_CHARS} AND len(w) >= {MIN_WORDS}
  AND {_share('text', P.alphabet)} >= 0.98 AND length(regexp_replace(text, '[^\\p{{L}}\\s]', '', 'g')) / length(text) >= 0.85 AND len(list_filter(w, lambda x: list_contains({_list(P.stop_words)}, x))) / len(w) <= 0.18"""

SQL = {
    "tokenize_offsets": _sql("doc", f"SELECT * FROM (SELECT doc_id, CAST(pos AS BIGINT) AS pos, piece, end_at - length(piece) AS start_at, end_at, CASE WHEN regexp_matches(piece, {CYR}) THEN 'word' WHEN regexp_matches(piece, '^[A-Za-z]') THEN 'latin' WHEN regexp_matches(piece, '^\\p{{Nd}}') THEN 'number' ELSE 'other' END AS kind FROM (SELECT doc_id, pos, piece, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_at FROM (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS piece FROM (SELECT doc_id, regexp_extract_all(text, {_q(f'(?s:{P.token}|.)')}, 0) AS ps FROM doc)))) WHERE kind <> 'other'"),
    "token_kinds": _sql("doc", f"SELECT source, CASE WHEN regexp_matches(t, {CYR}) THEN 'word' WHEN regexp_matches(t, '^[A-Za-z]') THEN 'latin' ELSE 'number' END AS kind, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, {TOKEN}, 0)) AS t FROM doc) GROUP BY ALL"),
    "normalize_text": _sql("doc", "SELECT doc_id, text FROM doc"),
    "nfc": "SELECT doc_id, nfc_normalize(replace(text, 'é', 'e' || chr(769))) AS text FROM documents",
    "mixed_script": _sql("doc", "SELECT doc_id, text FROM doc"),
    "sentence_filter": _sql("sentence", _KEPT),
    "sentence_dedup": _sql("sentence", "SELECT doc_id, source, sent_idx, text FROM sentence QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, sent_idx) = 1"),
    "letter_shares": _sql("doc", f"SELECT doc_id, round({_share('text', P.alphabet)}, 6) AS alphabet, round({_share('text', P.special)}, 6) AS special, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\p{{L}}\\s]', '', 'g')) / length(text) ELSE 0 END, 6) AS clean FROM doc"),
    "char_inventory": _sql("doc", f"""SELECT source, ch, n, {_LESS('n / sum(n) OVER (PARTITION BY source)')} AS share, CAST(contains('{P.alphabet}', lower(ch)) AS BIGINT) AS in_alphabet FROM (
  SELECT source, ch, count(*) AS n FROM (SELECT source, unnest(string_split(text, '')) AS ch FROM doc) WHERE ch <> '' GROUP BY GROUPING SETS ((source, ch), (ch)))"""),
    "char_vocabulary": _sql("doc", "SELECT ch, n, row_number() OVER (ORDER BY n DESC, ch) + 1 AS id FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM doc) WHERE ch <> '' GROUP BY ch HAVING count(*) >= 5)"),
    "source_profile": _sql("doc", f"""SELECT source, docs, chars, letters, {_LESS('special / letters')} AS special_share, {_LESS('(letters - own) / letters')} AS foreign_letter_share FROM (
  SELECT source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({_only('text', chr(92) + 'p{L}')}) AS BIGINT) AS letters, sum({_only('text', P.special)}) AS special, sum({_only('text', P.alphabet)}) AS own FROM doc GROUP BY source)"""),
    "lexicon_build": _sql("lexicon", "SELECT * FROM lexicon"),
    "lexicon_summary": _sql("lexicon", f"SELECT tier, source, count(DISTINCT form) AS forms, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (kind = 'core'), 0) AS BIGINT) AS core_tokens, {_LESS(_CORE_SHARE)} AS core_share FROM counts JOIN lexicon USING (form) GROUP BY ROLLUP (tier, source)"),
    "only_other": _sql("lexicon", "SELECT form, freq_other FROM lexicon WHERE kind = 'other'"),
    "heldout_split": _sql("sentence", f"SELECT doc_id, source, sent_idx FROM sentence QUALIFY (row_number() OVER (PARTITION BY source ORDER BY doc_id, sent_idx) - 1) % {HELDOUT_EVERY} = 0"),
    "shadows": _sql("shadow", "SELECT shadow, freq_shadow, found_in, origin, freq_origin, round(ratio, 6) AS ratio, demote FROM shadow"),
    "active_core": _sql("alive", "SELECT form, freq FROM core"),
    "verdicts": _sql("verdict", "SELECT * FROM verdict"),
    "verdicts_with_grammar": _sql("alive", "SELECT * FROM strict", _known("strict", "counts", grammar=True)),
    "hyphen_parts": _sql("alive", "SELECT * FROM doubled", "twice AS (SELECT form || '-' || form AS form FROM counts)", _known("doubled", "twice")),
    "coverage": _sql("lexicon", f"""SELECT tier, source, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (kind = 'core'), 0) AS BIGINT) AS core, CAST(coalesce(sum(n) FILTER (kind = 'tail'), 0) AS BIGINT) AS tail, CAST(coalesce(sum(n) FILTER (kind = 'other'), 0) AS BIGINT) AS miss, {_LESS("coalesce(sum(n) FILTER (kind = 'other'), 0) / sum(n)")} AS miss_share FROM counts JOIN lexicon USING (form) GROUP BY GROUPING SETS ((tier, source), (tier))"""),
    "top_missing": _sql("lexicon", f"SELECT form, CAST(sum(n) AS BIGINT) AS n FROM {_miss(_EDITED)} GROUP BY form ORDER BY n DESC, form LIMIT 300"),
    "unknown_by_tier": _sql("lexicon", f"SELECT tier, form, CAST(sum(n) AS BIGINT) AS n FROM {_miss('')} GROUP BY tier, form"),
    "acceptor_ablation": _sql("alive", " UNION ALL ".join(f"SELECT '{k}' AS config, tier, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (NOT ok), 0) AS BIGINT) AS rejected, {_LESS('coalesce(sum(n) FILTER (NOT ok), 0) / sum(n)')} AS share FROM counts JOIN v_{k} USING (form) GROUP BY tier" for k in _CONFIGS), *[_known(f"v_{k}", "counts", **o) for k, o in _CONFIGS.items()]),
    "denormalize": _sql("doc", f"SELECT doc_id, {_translate('clean', P.plain['ru'])} AS ru, {_translate('clean', P.plain['lat'])} AS lat, {_translate('replace(replace(clean, ' + _q('ҥ') + ', ' + _q('нг') + '), ' + _q('Ҥ') + ', ' + _q('Нг') + ')', P.plain['ru'])} AS ng FROM doc"),
    "restore_join": _sql("restored", "SELECT * FROM priced"),
    "restore_variants": _sql("lexicon", "SELECT form, array_to_string(list_transform(list_sort(list_transform(list_distinct(vs || [replace(form, 'нг', 'ҥ')]), lambda v: {'n': CASE WHEN length(v) = length(form) THEN len(list_filter(range(1, length(form) + 1), lambda i: substr(form, i, 1) <> substr(v, i, 1))) ELSE 1 END, 'v': v})), lambda x: x.v), ' ') AS variants FROM (SELECT form, " + _PRODUCT.format(f"list_transform(string_split(form, ''), lambda c: CASE WHEN contains('{_KEYS}', c) THEN [c, {_translate('c', P.restore)}] ELSE [c] END)") + f" AS vs FROM lexicon WHERE length(regexp_replace(form, '[^{_KEYS}]', '', 'g')) <= 4)"),
    **{f"rule_{k}": _sql("lexicon", f"SELECT form, {RULE[k]} AS hit FROM lexicon") for k in R.ALL},
    "rule_agreement": _sql("lexicon", " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER ({RULE[k]}) AS types_hit, CAST(coalesce(sum(n) FILTER ({RULE[k]}), 0) AS BIGINT) AS tokens_hit, {_LESS(f'count(*) FILTER ({RULE[k]}) / count(*)')} AS types_share, {_LESS(f'coalesce(sum(n) FILTER ({RULE[k]}), 0) / sum(n)')} AS tokens_share FROM coreform" for k in R.ALL), "coreform AS (SELECT form, sum(n) AS n FROM counts JOIN lexicon USING (form) WHERE kind = 'core' GROUP BY form)"),
    "lm_unigrams": _sql("bigram", "SELECT * FROM uni"),
    "lm_bigrams": _sql("bigram", "SELECT * FROM bi"),
    "lm_size": _sql("bigram", "SELECT (SELECT count(*) FROM uni) AS words, (SELECT CAST(sum(n) AS BIGINT) FROM uni) AS tokens, (SELECT count(*) FROM allpair) AS pairs, (SELECT CAST(sum(n) AS BIGINT) FROM allpair) AS pair_tokens"),
    "context_neighbours": _sql("context", "SELECT * FROM context"),
    "lm_scores": _sql("bigram context", f"""SELECT c.w_left, c.word, c.w_right, round(CASE WHEN lw.n > 0 THEN log10(lw.n / greatest(coalesce(ul.n, lw.n), 1)) ELSE log10({BACKOFF}) + log10((coalesce(uw.n, 0) + 0.5) / t.n) END
  + CASE WHEN wr.n > 0 THEN log10(wr.n / greatest(coalesce(uw.n, wr.n), 1)) ELSE log10({BACKOFF}) + log10((coalesce(ur.n, 0) + 0.5) / t.n) END, 6) AS context
  FROM (SELECT DISTINCT w_left, word, w_right FROM context) c CROSS JOIN (SELECT CAST(sum(n) AS DOUBLE) AS n FROM uni) t LEFT JOIN uni ul ON ul.word = c.w_left LEFT JOIN uni uw ON uw.word = c.word LEFT JOIN uni ur ON ur.word = c.w_right
  LEFT JOIN bi lw ON lw.w1 = c.w_left AND lw.w2 = c.word LEFT JOIN bi wr ON wr.w1 = c.word AND wr.w2 = c.w_right"""),
    "correct_restore_only": _sql("best", f"SELECT d.doc_id, coalesce(string_agg({_CASED.format('coalesce(b.form, p)')}, '' ORDER BY pos), '') AS text FROM doc d LEFT JOIN piece USING (doc_id) LEFT JOIN verdict v ON is_word AND v.form = lower(p) AND NOT v.ok LEFT JOIN best b ON b.word = v.form GROUP BY d.doc_id".replace(_CASED.format("coalesce(b.form, p)"), f"CASE WHEN b.form IS NULL THEN p ELSE {_CASED.format('b.form')} END"), shadow=ALL_SHADOWS),
    "restore_corrections": _sql("best", _CORRECTIONS),
    "stream_check": _sql("best", _CORRECTIONS),
    "clean_references": _sql("best", "SELECT d.doc_id, coalesce(string_agg(CASE WHEN k.origin IS NULL THEN p WHEN p = lower(p) THEN k.origin ELSE upper(left(k.origin, 1)) || substr(k.origin, 2) END, '' ORDER BY pos), '') AS text FROM doc d LEFT JOIN piece USING (doc_id) LEFT JOIN dark k ON is_word AND k.shadow = lower(p) GROUP BY d.doc_id"),
    "bench_denorm_full": _sql("pair", "SELECT id, task, count(*) AS words, count(*) FILTER (before <> after) AS n_edits FROM pair GROUP BY id, task"),
    "diff_words": _sql("pair", "SELECT id, word_idx AS pos, before, after FROM pair WHERE before <> after"),
    "bench_metrics": _sql("best pair", _METRICS.replace("{flag}", "NOT v.ok")),
    "pipeline_metrics": _sql("best pair", _METRICS.replace("{flag}", "b.form IS NOT NULL")),
    "threshold_sweep": _sql("pair", _SWEEP, _PROPOSED),
    "best_threshold": _sql("pair", f"SELECT task, threshold, f1 FROM ({_SWEEP}) WHERE fpr <= 0.01 QUALIFY row_number() OVER (PARTITION BY task ORDER BY f1 DESC, threshold) = 1", _PROPOSED),
    "reference_audit": _sql("best", f"""SELECT r.doc_id AS id, n_issues, words, {_LESS('n_issues / greatest(words, 1)')} AS share, issues FROM (
  SELECT doc_id, count(*) AS n_issues, string_agg(p || '>' || {_CASED.format('b.form')} || '/' || CASE v.reason WHEN 'shadow' THEN 'shadow' ELSE 'unknown' END, ' ' ORDER BY pos) AS issues
  FROM piece JOIN verdict v ON is_word AND v.form = lower(p) AND NOT v.ok JOIN best b ON b.word = v.form GROUP BY doc_id)
  JOIN (SELECT min(doc_id) AS doc_id, CAST(len({_words('text')}) AS BIGINT) AS words FROM doc WHERE trim(text) <> '' GROUP BY text) r USING (doc_id)"""),
    "ceiling": _sql("verdict pair", f"SELECT task, count(*) AS wrong, count(*) FILTER (ok) AS accepted, {_LESS('count(*) FILTER (ok) / count(*)')} AS share FROM pair JOIN verdict ON form = lower(before) WHERE lower(before) <> lower(after) GROUP BY task"),
    "rule_catches": _sql("pair", " UNION ALL ".join(f"SELECT task, '{k}' AS rule, CAST(coalesce(sum(n) FILTER (gold AND ({RULE[k]})), 0) AS BIGINT) AS caught, CAST(coalesce(sum(n) FILTER (NOT gold AND ({RULE[k]})), 0) AS BIGINT) AS cost FROM seen GROUP BY task" for k in R.ALL), "seen AS (SELECT task, lower(before) AS form, lower(before) <> lower(after) AS gold, count(*) AS n FROM pair GROUP BY ALL)"),
    "userdict_verdict": _sql("verdict", "SELECT DISTINCT form FROM (SELECT form FROM asked WHERE form IN (SELECT form FROM own) UNION ALL SELECT whole FROM (SELECT whole, bool_or(o.form IS NOT NULL) AS any_mine, bool_and(o.form IS NOT NULL OR coalesce(v.ok, false)) AS all_ok FROM (SELECT form AS whole, unnest(list_filter(string_split(form, '-'), lambda p: p <> '')) AS form FROM asked WHERE len(list_filter(string_split(form, '-'), lambda p: p <> '')) > 1) x LEFT JOIN own o ON o.form = x.form LEFT JOIN verdict v ON v.form = x.form GROUP BY whole) WHERE any_mine AND all_ok)", "own AS (SELECT form FROM counts JOIN verdict USING (form) WHERE NOT ok GROUP BY form ORDER BY sum(n) DESC, form LIMIT 200)", "asked AS (SELECT DISTINCT form FROM counts UNION SELECT form || '-' || form FROM own)"),
    "apply_tags": _sql("doc", "SELECT doc_id, replace(translate(text, 'оугОУГ', 'өүҕӨҮҔ'), 'ь', '') AS text FROM doc"),
    "front_coding": _sql("lexicon", "SELECT form, n AS prefix, substr(form, n + 1) AS tail FROM (SELECT form, list_max(list_filter(range(0, least(length(form), length(prev), 40) + 1), lambda i: left(form, i) = left(prev, i))) AS n FROM (SELECT form, coalesce(lag(form) OVER (PARTITION BY left(form, 1) ORDER BY form), '') AS prev FROM lexicon WHERE kind = 'core'))"),
    "freq_quantise": _sql("lexicon", "SELECT form, code, round(pow(2.0, code / 16), 6) AS freq FROM (SELECT form, CAST(least(255, floor(log2(freq + 1) * 16)) AS BIGINT) AS code FROM lexicon WHERE kind = 'core')"),
    "corpus_counters": _sql("sentence", "SELECT s.source, count(*) AS seen, count(k.text) AS kept, count(*) FILTER (k.rn = 1) AS uniq FROM sentence s LEFT JOIN numbered k ON k.doc_id = s.doc_id AND k.sent_idx = s.sent_idx GROUP BY s.source", f"kept AS ({_KEPT})", "numbered AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, sent_idx) AS rn FROM kept)"),
}
