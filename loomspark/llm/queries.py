"""The thirteen queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import conversations, decontamination, fingerprints, jaccard, lines, merkle, mixing, quality, secrets, sharding, substrings, tokens, toxicity
from loomspark.llm._store import documents as table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return secrets.digest_of(secrets.find_secrets(docs, secrets.train(secrets.samples_of(docs))))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_of(substrings.dedup_substrings(table(spark, sf_dir)))


def tree() -> dict:
    """The tree for documents: four domains by the source's number, languages, sources of equal weight."""
    n = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    domain = F.when(n < 5, "web").when(n < 10, "books").when(n < 15, "forums").when(n >= 15, "reference").otherwise("other")
    by = {"web": 40, "books": 30, "forums": 20, "reference": 10}
    domain_weight = F.coalesce(*[F.when(domain == k, v) for k, v in by.items()], F.lit(5))
    lang_weight = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in {"en": 60, "de": 15, "fr": 15, "es": 10}.items()], F.lit(5))
    return {"domain": (domain, domain_weight), "language": (F.col("lang"), lang_weight), "origin": (F.col("source"), F.lit(1))}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir), tree())
    return out.select("doc_id", "mix_domain", "mix_language", "mix_origin", "epoch", "n_tokens")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.shingle_components(table(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir))


def severity_labels(labels: DataFrame) -> DataFrame:
    """The grades that the table has: 0 not toxic, 1 toxic. The operator takes as many as a table holds."""
    return labels.select("doc_id", F.col("toxic").alias("grade"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    model = toxicity.train(docs, severity_labels(table(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(docs, model)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.repair_report(turns, conversations.damaged(turns))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    out = sharding.shuffle_shards(table(spark, sf_dir), size=F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col(c) for c in merkle.DOCUMENT]
    changed = merkle.leaf([merkle.lower(c) if n == "text" else c for n, c in zip(merkle.DOCUMENT, columns, strict=True)])
    made = merkle.manifest(table(spark, sf_dir), columns=merkle.DOCUMENT, other=F.when(merkle.tampered(F.col("doc_id")), changed))
    out = merkle.proofs(made)
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP1_SQL = """
with rows as (select distinct doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i, len(string_split(text, chr(10))) as n from rows),
h as (select *, ('0x' || substr(md5(line), 1, 8))::bigint as h from l),
f as (select *, (h + coalesce(lag(h) over w, 0) * 31) % 2 = 0 as falls from h window w as (partition by doc_id, text order by i)),
e as (select *, falls and not lag(falls) over w and i > 0 and i < n - 2 or i = n - 1 as ends from f window w as (partition by doc_id, text order by i)),
c as (select *, coalesce(sum(ends::int) over (partition by doc_id, text order by i rows between unbounded preceding and 1 preceding), 0) as chunk from e),
g as (select doc_id, text, chunk, min(i) as start, count(*) as n, string_agg(line, chr(10) order by i) as body from c group by all),
r as (select *, row_number() over (partition by body order by doc_id, start) as nth from g where n > 1),
k as (select c.*, coalesce(r.nth, 1) > 1 as gone from c left join r using (doc_id, text, chunk))
select doc_id, case when text = '' then 0 else count(*) end as n_lines, count(*) filter (gone) as n_removed_lines,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from k group by doc_id, text
"""

_TREE_SQL = """
d0 as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as tokens, try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) as n, coalesce(lang, '') as language, coalesce(source, '') as origin from documents),
d as (select *, case when n < 5 then 'web' when n < 10 then 'books' when n < 15 then 'forums' when n >= 15 then 'reference' else 'other' end as domain from d0 where tokens > 0),
leaf as (select domain, language, origin, sum(tokens)::hugeint as stock, sum(tokens)::hugeint * 4 as cap,
  case domain when 'web' then 40 when 'books' then 30 when 'forums' then 20 when 'reference' then 10 else 5 end as w1,
  case language when 'en' then 60 when 'de' then 15 when 'fr' then 15 when 'es' then 10 else 5 end as w2 from d group by all)
"""


def _level_sql(name: str, path: list[str], weight: str, up: str) -> str:
    over = ", ".join(path[:-1]) or "0"
    return f"""
{name}a as (select {", ".join(f"leaf.{p}" for p in path)}, sum(cap) as cap, max({weight})::hugeint as w, max({up}.share) as b from leaf {"cross join " + up if len(path) == 1 else f"join {up} using ({', '.join(path[:-1])})"} group by {", ".join(f"leaf.{p}" for p in path)}),
{name}b as (select *, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as before, sum(w) over (o rows between current row and unbounded following) as wr from {name}a window o as (partition by {over} order by cap / w, {path[-1]})),
{name}c as (select *, cap * wr <= w * (b - before) as is_full from {name}b),
{name} as (select {", ".join(path)}, case when is_full then cap else greatest((w * (b - coalesce(sum(cap) filter (is_full) over (partition by {over}), 0))) // sum(w) filter (not is_full) over (partition by {over}), 0) end as share from {name}c)"""


OP6_SQL = f"""
with {_TREE_SQL}, root as (select sum(stock) // 2 as share from leaf),
{_level_sql("l1", ["domain"], "w1", "root")}, {_level_sql("l2", ["domain", "language"], "w2", "l1")}, {_level_sql("l3", ["domain", "language", "origin"], "1", "l2")},
s as (select domain, language, origin, share // stock as whole, share % stock as rest from leaf join l3 using (domain, language, origin)),
o as (select d.*, whole, rest, ('0x' || substr(md5('42:' || (whole + 1)::varchar || ':' || doc_id::varchar), 1, 15))::bigint as u from d join s using (domain, language, origin)),
p as (select *, whole + (sum(tokens) over (partition by domain, language, origin order by u, doc_id rows unbounded preceding) <= rest)::int as copies from o)
select doc_id, domain as mix_domain, language as mix_language, origin as mix_origin, unnest(range(1, copies::bigint + 1))::int as epoch, tokens::bigint as n_tokens from p
"""


def _crc32_tables(texts: str, bits: int = 21) -> str:
    """Tables for the CRC-32 of texts (a query of one column, text) of up to 2**bits / 8 bytes: crc has text and crc.

    The register is linear in the input, so that the sum (xor) of what each set bit becomes on its way is the result.
    p0 has what a 1 becomes after k steps; each following table twice as many steps, made of the one before.
    """
    out = ["p0(k, v) as (select 0, 1::bigint union all select k + 1, xor(v >> 1, (v & 1) * 3988292384::bigint) from p0 where k < 64)"]
    last = f"p{bits - 6}"
    for j in range(6, bits):
        old, new = f"p{j - 6}", f"p{j - 5}"
        out.append(f"{new} as materialized (select * from {old} union all select a.k + {1 << j}, bit_xor(b.v) from {old} a, range(32) r(i) join {old} b on b.k = {1 << j} - i where a.k > 0 and (a.v >> i) & 1 = 1 group by a.k)")
    last = f"p{bits - 6}"
    # blocks of 64 bytes, counted from the end, meet a small table of what a byte becomes until its block ends; what a block becomes until the end follows
    out.append(f"tab as materialized (select p, printf('%02X', b) as b, bit_xor(v) as v from (select p, b, 8 * (p + 1) - j as k from range(64) s(p), range(256) t(b), range(8) u(j) where (b >> j) & 1 = 1) join {last} using (k) group by all)")
    out.append("bytes as materialized (select text, strlen(text) as n, row_number() over () as nr from (" + texts + "))")
    out.append("each as (select nr, unnest(h) as b, n - generate_subscripts(h, 1) as d from (select nr, n, regexp_extract_all(hex(encode(text)), '..') as h from bytes))")
    out.append("blocks as materialized (select nr, d // 64 as q, bit_xor(v) as x from each join tab on tab.p = d % 64 and tab.b = each.b group by all)")
    out.append(f"ways as (select nr, x as v from blocks where q = 0 union all select nr, v from (select nr, 512 * q - j as k from blocks, range(32) r(j) where q > 0 and (x >> j) & 1 = 1 union all select nr, 8 * n - j from bytes, range(32) r(j) where n > 0) join {last} using (k))")
    out.append("sums as materialized (select nr, bit_xor(v) as x from ways group by nr)")
    out.append("crc as (select b.text, xor(xor(coalesce(o.x, 0), case when n = 0 then 4294967295::bigint when n < 4 then 4294967295::bigint >> (8 * n) & -2 else 0 end), 4294967295::bigint) as crc from bytes b left join sums o using (nr))")
    return ",\n".join(out)


def _draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::bigint"


def _field_sql(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


OP12_SQL = f"""
with recursive {_crc32_tables("select distinct coalesce(text, '') as text from documents")},
r as (select doc_id, coalesce(text, '') as text, md5({' || '.join(map(_field_sql, ('doc_id', 'text', 'lang', 'source', 'n_chars')))}) as key from documents),
n as (select *, row_number() over (partition by key) - 1 as nth, count(*) over () as n, sum(strlen(text)) over () as total from r),
b as (select *, {_draw_sql("'42:bucket'", 'key', 'nth')} % greatest(1, (total + {sharding.BUCKET_BYTES} - 1) // {sharding.BUCKET_BYTES}, (n + {sharding.BUCKET_ROWS} - 1) // {sharding.BUCKET_ROWS}) as bucket from n),
i as (select *, row_number() over (partition by bucket order by key, nth) - 1 as i from b),
d as (select bucket, list([i::bigint, ({_draw_sql("'42:order'", 'bucket', 'i')} % (i + 1))::bigint] order by i) as steps from i group by bucket),
f as (select bucket, list_reduce(steps, lambda a, s: case when s[1] = s[2] then a || [s[1]] else a[1:s[2]] || [s[1]] || a[s[2] + 2:] || [a[s[2] + 1]] end, []::bigint[]) as perm from d),
o as (select bucket, unnest(perm) as i, generate_subscripts(perm, 1) as pos from f),
p as (select i.*, row_number() over (order by bucket, pos) - 1 as place from i join o using (bucket, i)),
s as (select *, place * 16 // n as shard from p)
select doc_id, strlen(text)::bigint + 1 as size, crc::bigint as text_crc32, 'rows' as law, shard::int as shard, (place - (shard * n + 15) // 16)::bigint as slot, null::int as grown_shard from s join crc using (text)
"""


def _levels_sql(name: str, leaves: str) -> str:
    """Tables of four levels over leaves (g, p, n, h), for up to 65,536 of a group: runs, the path of each p, the last node."""
    out = [f"{name}0 as ({leaves})"]
    for k in range(4):
        out.append(f"{name}r{k} as (select g, p // 16 as q, list(h order by p) as run, any_value(n) as n from {name}{k} group by all)")
        out.append(f"{name}{k + 1} as (select g, q as p, (n + 15) // 16 as n, case when n = 1 then run[1] else sha256(array_to_string(run, '')) end as h from {name}r{k})")
    side = ", ".join(f"case when r{k}.n > 1 then struct_pack(l := array_to_string(r{k}.run[1:(x.p >> {4 * k}) % 16], ''), r := array_to_string(r{k}.run[(x.p >> {4 * k}) % 16 + 2:], '')) end" for k in range(4))
    joins = " ".join(f"join {name}r{k} r{k} on r{k}.g = x.g and r{k}.q = x.p >> {4 * k + 4}" for k in range(4))
    out.append(f"{name}paths as (select x.g, x.p, [{side}] as path from {name}0 x {joins})")
    return ",\n".join(out)


def _fold_sql(start: str, path: str) -> str:
    for k in range(8):
        s = f"{path}[{k + 1}]"
        start = f"(select case when {s} is null then h else sha256({s}.l || h || {s}.r) end from (select {start} as h))"
    return start


OP13_SQL = f"""
with recursive {_crc32_tables("select distinct doc_id::varchar as text from documents where doc_id is not null", 8)},
d as (select doc_id, coalesce('s' || source, '') as g, sha256({' || '.join(map(_field_sql, ['documents.text' if c == 'text' else c for c in merkle.DOCUMENT]))}) as h,
  case when crc % 5 = 0 then sha256({' || '.join(map(_field_sql, [*merkle.DOCUMENT[:-1], "translate(documents.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"]))} ) end as other from documents left join crc on crc.text = doc_id::varchar),
l as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as p, count(*) over (partition by g) as n from d),
{_levels_sql('a', 'select g, p, n, h from l')},
{_levels_sql('b', "select '' as g, row_number() over (order by g) - 1 as p, count(*) over () as n, h from a4")},
o as (select g, row_number() over (order by g) - 1 as p from a4),
f as (select l.doc_id, l.h as leaf, coalesce(l.other, l.h) as other, a4.h as subroot, b4.h as root, apaths.path || bpaths.path as path
  from l join apaths using (g, p) join a4 on a4.g = l.g join o on o.g = l.g join bpaths on bpaths.p = o.p, b4),
e as (select *, {_fold_sql('f.other', 'f.path')} as folded_root from f)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) as proof_sha256, folded_root, folded_root = root as verified from e
"""

_SPACE = r"\x20\x09-\x0D"
_MOVES_SQL = ", ".join(f"('{m['kind']}', {m['src']}, {m['dst']}, {m['cost']}, '{m['letters']}')" for m in conversations.moves().to_pylist())
_ENDS_SQL = ", ".join(f"({state}, {cost}, '{letters}')" for state, (cost, letters) in conversations.END.items())
OP11_SQL = f"""
with recursive {_crc32_tables("select distinct coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as text from conversations", 9)},
k as (select coalesce('c' || conv_id, '') as g, turn, coalesce(role, ' ') as role, coalesce(c.text, ' ') as text, crc % 20 as kind from conversations c join crc on crc.text = coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')),
d as (select g, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case kind when 3 then [0, 1] else [0] end) as copy from k where kind <> 0),
p as (select *, row_number() over (partition by g order by turn nulls first, role, md5(text), copy) - 1 as pos, row_number() over (partition by g, role, text order by turn nulls first, copy) as nth from d),
f as materialized (select *, case when not regexp_matches(text, '[^{_SPACE}]') then 'blank' when nth > 1 then 'duplicate' when not regexp_matches(text, '[.!?][{_SPACE}]*$') then 'truncated' end as fault, case when role[1] in ('s', 'u', 'a') then role[1] else 'x' end as letter from p),
moves(kind, src, dst, cost, letters) as (values {_MOVES_SQL}),
steps as materialized (select g, pos, src, dst, cost, letters from f join moves on kind = letter || case when fault in ('blank', 'duplicate') then 'd' when fault = 'truncated' then 't' else 'k' end),
walk(g, pos, state, cost, audit) as (
  select distinct g, 0::bigint, 0, 0::bigint, '' from f
  union all select g, pos + 1, dst, best.cost, best.audit from (
    select w.g, w.pos, s.dst, min(struct_pack(cost := w.cost + s.cost, audit := w.audit || s.letters)) as best from walk w join steps s on s.g = w.g and s.pos = w.pos and s.src = w.state group by all)),
n as (select g, count(*) as pos, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated from f group by g),
ends(state, more, letters) as (values {_ENDS_SQL}),
b as materialized (select g, min(struct_pack(cost := cost + more, audit := audit || letters)) as best from walk join n using (g, pos) join ends using (state) group by g),
e as (select g, unnest(string_split(best.audit, '')) as edit, generate_subscripts(string_split(best.audit, ''), 1) as i from b where best.audit <> ''),
r as (select *, sum((edit <> 'I')::int) over (partition by g order by i) - 1 as pos from e),
m as (select r.g, i, edit, f.role, f.text, f.letter, row_number() over (partition by r.g order by i) - 1 as nth from r left join f on f.g = r.g and f.pos = r.pos and edit <> 'I' where edit <> 'D'),
t as (select *, max((nth = 0 and edit = 'K' and letter = 's')::int) over (partition by g) as led from m),
h as (select g, sha256(string_agg(case when edit = 'K' then role when (nth - led) % 2 = 0 then 'user' else 'assistant' end || ':' || case edit when 'I' then '' else text end, chr(10) order by i)) as sha from t group by g),
l as (select g, lag(letter) over (partition by g order by pos) || letter as pair from f),
q as (select g, count(*) as illegal from l where pair not in ('su', 'ua', 'au') group by g),
a as (select distinct conv_id, coalesce('c' || conv_id, '') as g from conversations)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from a left join n using (g) left join b using (g) left join h using (g) left join q using (g)
"""

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_quality, op4_secrets, op5_substring_dedup, op6_mixing, op7_jaccard_join, op8_fingerprints, op9_toxicity, op10_decontamination, op11_conversations, op12_sharding, op13_merkle)}
SQL = {"op1_line_dedup": OP1_SQL, "op6_mixing": OP6_SQL, "op11_conversations": OP11_SQL, "op12_sharding": OP12_SQL, "op13_merkle": OP13_SQL}
