"""DuckDB SQL for the registered queries, written from the operators' definitions."""

from __future__ import annotations

from filetrail.plans.bindings import EVIDENCE_SQL

ORACLES: dict[str, str] = {}

EVIDENCE = EVIDENCE_SQL.replace("{documents}", "documents")

UPLOADS = """
 up as (select lang as session_id, doc_id as arrival, substr(sha256(text),1,16) as file_id, sha256(text) as sha256,
   'doc-' || doc_id || '.txt' as filename, n_chars as width,
   length(text) - length(replace(text, chr(10), '')) + 1 as height, source, text from documents)"""

_BIT_SUMS = ", ".join(f"sum(((h >> {i}) & 1)::bigint) as b{i}" for i in range(64))
_PACK = " + ".join(f"(case when b{i} * 2 > n then {1 << i}::uhugeint else 0::uhugeint end)" for i in range(64))
MARKS = f"""
 words as (select doc_id, string_split(text, ' ') as w from documents),
 grams as (select doc_id, unnest(list_distinct(list_transform(generate_series(1, len(w) - 2),
   lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))) as g from words where len(w) >= 3),
 votes as (select doc_id, ('0x' || substr(md5(g), 1, 16))::ubigint as h from grams),
 tally as (select doc_id, count(*) as n, {_BIT_SUMS} from votes group by doc_id),
 marks as (select doc_id, ({_PACK})::ubigint as phash from tally)"""

LIVES = f"""{UPLOADS}, {MARKS},
 lives as (select up.*, marks.phash, lead(arrival) over (partition by session_id, file_id order by arrival) as ends
   from up left join marks on doc_id = arrival)"""

MATCHES = f"""{LIVES},
 ranked as (select c.session_id, c.arrival, p.file_id as parent_file_id, p.arrival as parent_order,
   bit_count(xor(c.phash, p.phash)) as metric from lives c join lives p on c.session_id = p.session_id
   and p.arrival < c.arrival and (p.ends is null or c.arrival <= p.ends)
   where bit_count(xor(c.phash, p.phash)) <= 10
   qualify row_number() over (partition by c.session_id, c.arrival order by bit_count(xor(c.phash, p.phash)), p.arrival) = 1)"""

CHANGES = f"""{MATCHES},
 pairs as (select l.*, r.parent_file_id, r.parent_order, r.metric, p.filename as parent_filename, p.sha256 as parent_sha256,
   p.width as pw, p.height as ph, (l.width * l.height)::double / (p.width * p.height) as ratio
   from lives l left join ranked r using (session_id, arrival)
   left join lives p on p.session_id = l.session_id and p.arrival = r.parent_order),
 changed as (select *, case when parent_file_id is null then null when sha256 = parent_sha256 then 'identical (bit-for-bit)'
   else coalesce(nullif(concat_ws(', ',
     case when width = 0 or height = 0 or pw = 0 or ph = 0 then null
       when ratio < 0.98 and abs(width::double / height - pw::double / ph) > 0.03 then 'cropped'
       when ratio < 0.98 then 'resized ' || round_even(ratio * 100, 0)::bigint || '%'
       when ratio > 1.02 then 'upscaled ' || round_even(ratio * 100, 0)::bigint || '%' end,
     case when arrival % 7 = 0 then 'WhatsApp (1 hop)' end,
     case when arrival % 11 = 0 then 'screenshot' end), ''), 're-encoded') end as transformations from pairs)"""

RESULTS = f"""{CHANGES},
 res as (select * from changed qualify row_number() over (partition by session_id, file_id order by arrival desc) = 1),
 edges as (select r.session_id, r.parent_file_id as source, r.file_id as target, coalesce(nullif(r.transformations, ''), 'derived') as label
   from res r where exists (select 1 from res p where p.session_id = r.session_id and p.file_id = r.parent_file_id))"""

# --- sources and sinks
ORACLES["scan_curated"] = f"""with {UPLOADS}
 select l.doc_id as seq, up.filename, up.sha256 from labels l join up on up.filename = 'doc-' || (l.doc_id * 2) || '.txt'"""
ORACLES["split_rejects"] = f"""with t as ({EVIDENCE}) select t.doc_id, case when n_chars - 40 = 0 then '400'
 when n_chars - 40 > 8000 then '413' when exif_exposure = 2.0 then '422' end as reason from t join documents d on d.doc_id = t.doc_id"""
ORACLES["prior_files"] = f"""with {LIVES}
 select arrival, file_id, filename, sha256, format('{{:016x}}', phash) as phash, width, height from lives where session_id = 'en'
 qualify row_number() over (partition by session_id, file_id order by arrival desc) = 1"""
ORACLES["upsert_latest"] = """select user_id, event_type, event_id, value, props from events
 qualify row_number() over (partition by user_id, event_type order by ts desc) = 1"""
ORACLES["lookup_result"] = f"""with {UPLOADS},
 res as (select * from up qualify row_number() over (partition by session_id, file_id order by arrival desc) = 1),
 wanted as (select l.doc_id as asked_by, case when l.quality = 1 then up.session_id else 'none' end as session_id, up.file_id
   from labels l join up on up.arrival = l.doc_id)
 select asked_by, w.session_id, w.file_id, filename, sha256, width from wanted w left join res on res.session_id = w.session_id and res.file_id = w.file_id"""
ORACLES["result_json_roundtrip"] = f"""with {UPLOADS}
 select session_id, file_id, arrival, filename, width, case when height > 1 then height end as height from up"""
ORACLES["blob_stride"] = """select doc_id, unnest(generate_series(0, len(w) - 1)) as kp,
 unnest(list_transform(w, lambda x: sha256(x))) as descriptor from (select doc_id, string_split(text, ' ') as w from documents)"""

# --- evidence
_KIND = "case doc_id % 4 when 0 then 'jpeg' when 1 then 'png' when 2 then 'pdf' else 'unknown' end"
ORACLES["sniff_format"] = f"select doc_id, {_KIND} as actual_format from documents"
ORACLES["declared_format"] = """select page_id, case when position('.' in url) = 0 then 'unknown'
 when lower(regexp_extract(url, '([^.]*)$', 1)) = 'jpg' then 'jpeg'
 else coalesce(nullif(lower(regexp_extract(url, '([^.]*)$', 1)), ''), 'unknown') end as declared_format from pages"""
ORACLES["format_mismatch"] = f"""with t as (select doc_id, {_KIND} as a,
 case doc_id % 3 when 0 then 'jpeg' when 1 then 'png' else 'unknown' end as d from documents)
 select doc_id, (a <> 'unknown' and d <> 'unknown' and a <> d)::int as mismatch from t"""

_JPEG_PARTS = """
 parts as (
  select doc_id, k as seq, 'FFFE' as type, least(60000, bytes - k * 60000) as body,
    md5(substr(hex(encode(text)), (k * 120000 + 1)::bigint, 120000).unhex()) as payload_md5
  from (select doc_id, text, octet_length(encode(text)) as bytes, unnest(generate_series(0, ((octet_length(encode(text)) + 59999) // 60000) - 1)) as k from documents)
  union all select doc_id, 1000, 'FFDB', 65, md5(unhex('00' || repeat(lpad(hex(1 + doc_id % 5), 2, '0'), 64))) from documents where doc_id % 4 <> 0
  union all select doc_id, 1001, 'FFDB', 65, md5(unhex('01' || repeat(lpad(hex(1 + doc_id % 3), 2, '0'), 64))) from documents where doc_id % 4 <> 0
  union all select doc_id, 1000, 'FFDB', 194, md5(unhex('00' || repeat(lpad(hex(1 + doc_id % 5), 2, '0'), 64) || '11' || repeat(lpad(hex(1 + doc_id % 3), 4, '0'), 64))) from documents where doc_id % 4 = 0
  union all select doc_id, 1002, case when doc_id % 2 = 1 then 'FFC2' else 'FFC0' end, 15,
    md5(unhex('08' || lpad(hex(1 + doc_id % 4000), 4, '0') || lpad(hex(1 + n_chars % 60000), 4, '0') || '0301' ||
      case doc_id % 5 when 0 then '22' when 1 then '21' when 2 then '12' when 3 then '11' else '41' end || '00021101031101')) from documents
  union all select doc_id, 1003, 'FFDA', 10, md5(unhex(repeat('00', 10))) from documents)"""
ORACLES["jpeg_segments"] = f"""with {_JPEG_PARTS}
 select doc_id, row_number() over w - 1 as seg_no, type, 2 + sum(body + 4) over w - (body + 4) as "offset", body + 2 as length, payload_md5
 from parts window w as (partition by doc_id order by seq)"""
ORACLES["png_chunks"] = """with c as (
  select doc_id, 0 as seg_no, 'IHDR' as type, 8 as "offset", 13 as length,
   md5(unhex(lpad(hex(1 + n_chars), 8, '0') || lpad(hex(1 + doc_id % 4000), 8, '0') || '0802000000')) as payload_md5 from documents
  union all select doc_id, 1, 'tEXt', 33, octet_length(encode(text)), md5(text) from documents
  union all select doc_id, 2, 'IEND', 45 + octet_length(encode(text)), 0, md5('') from documents where doc_id % 13 <> 5)
 select * from c"""
ORACLES["image_dims"] = """select doc_id, 1 + n_chars % 60000 as width, 1 + doc_id % 4000 as height, 'jpeg' as format from documents
 union all select doc_id, 1 + n_chars, 1 + doc_id % 4000, 'png' from documents"""
ORACLES["trailing_bytes"] = """select doc_id, case when doc_id % 13 <> 5 and doc_id % 9 = 4 then 24 else 0 end as trailing_bytes,
 (doc_id % 13 = 5)::int as truncated, 'jpeg' as format from documents
 union all select doc_id, case when doc_id % 13 <> 5 and doc_id % 9 = 4 then 8 else 0 end, (doc_id % 13 = 5)::int, 'png' from documents"""
ORACLES["quant_tables"] = """select doc_id, 0 as table_id, array_to_string(list_transform(range(64), lambda x: 1 + doc_id % 5), ',') as table_values from documents
 union all select doc_id, 1, array_to_string(list_transform(range(64), lambda x: 1 + doc_id % 3), ',') from documents"""
ORACLES["encoder_fp"] = """select doc_id, (doc_id % 5 = doc_id % 3)::int as quant_identical, (doc_id % 2)::int as progressive,
 case doc_id % 5 when 0 then '4:2:0' when 1 then '4:2:2' when 2 then '4:4:0' when 3 then '4:4:4' else 'custom((4, 1)/(1, 1))' end as chroma_subsampling,
 (doc_id % 5 = 0 and doc_id % 3 = 0)::int as near_lossless from documents"""
ORACLES["dispatch_evidence"] = f"""select doc_id, {_KIND} as actual_format,
 case doc_id % 4 when 0 then 1 + n_chars % 60000 when 1 then 1 + n_chars end as width,
 case when doc_id % 4 < 2 then 1 + doc_id % 4000 end as height,
 case when doc_id % 4 > 1 or doc_id % 13 = 5 or doc_id % 9 <> 4 then 0 when doc_id % 4 = 0 then 24 else 8 end as trailing_bytes,
 case when doc_id % 4 = 0 then (doc_id % 2)::int else 0 end as progressive,
 case when doc_id % 4 = 2 then 'Maker ' || (doc_id % 3) end as pdf_producer, 0 as exif_present, 0 as c2pa_present from documents"""
ORACLES["tag_pivot"] = "select user_id, " + ", ".join(
    f"arg_max(value, ts) filter (where event_type = '{k}') as {k}" for k in ("click", "error", "purchase", "signup", "view")
) + " from events group by user_id"
ORACLES["exif_normalise"] = f"""with t as ({EVIDENCE}) select doc_id,
 coalesce(nullif(exif_original, ''), exif_changed) as datetime_original,
 coalesce(nullif(exif_subsec_original, ''), exif_subsec) as subsec_time from t"""
_EXPOSURE = "case when exif_exposure <> 0 then '1/' || round_even(1 / exif_exposure, 0)::bigint end"
ORACLES["exposure_text"] = f"with t as ({EVIDENCE}) select doc_id, {_EXPOSURE} as exposure from t"
ORACLES["gps_decimal"] = f"""with t as ({EVIDENCE}) select doc_id, case when lat_parts = 3 then
 round((lat_degrees + lat_minutes / 60.0e0 + lat_seconds / 3600.0e0) * case when lat_ref in ('S', 'W') then -1 else 1 end, 6) end as latitude from t"""
ORACLES["reassemble_parts"] = """select doc_id, md5(array_to_string(list_reverse(string_split(text, ' ')), '')) as whole_md5 from documents"""
ORACLES["icc_text"] = """select doc_id, 1 as present, md5(trim(regexp_replace(unhex_text, '', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as description_md5,
 '(c) ' || source as copyright from (select doc_id, source,
   array_to_string(list_transform(string_split(text, ''), lambda c: case when octet_length(encode(c)) = 1 then c else repeat(chr(65533), octet_length(encode(c))) end), '') as unhex_text from documents)"""


def _box(kind: str, body: str) -> str:
    return f"(unhex(lpad(hex(octet_length({body}) + 8), 8, '0')) || encode('{kind}') || {body})"


def _described(label: str, children: str) -> str:
    jumd = _box("jumd", f"(unhex(repeat('00', 16) || '01') || encode({label}) || unhex('00'))")
    return _box("jumb", f"({jumd} || {children})")


_INNER = _box("json", """encode('{"softwareAgent":"late","actions":[{"when":"2026-08-12T10:00:00Z"}]}')""")
_OUTER = _box("json", """encode('{"body":' || to_json(text)::varchar || ',"softwareAgent":"tool ' || source || '"}')""")
_STREAM = _described("lang", f"{_OUTER} || {_described('source', _INNER)}")
ORACLES["claim_stream"] = f"select doc_id, octet_length(s) as bytes, sha256(s) as stream_sha from (select doc_id, {_STREAM} as s from documents)"
ORACLES["box_labels"] = """select doc_id, array_to_string(list_sort(list_distinct([lang, source])), '|') as labels from documents"""
ORACLES["claim_evidence"] = """select doc_id, 'tool ' || source as c2pa_agent, 'tool ' || source as c2pa_generator,
 '2026-08-12T10:00:00Z' as c2pa_when, array_to_string(list_sort(list_distinct([lang, source])), '|') as labels from documents"""
ORACLES["first_key_values"] = """select user_id, event_type, arg_min(json_extract_string(props, '$.k'), ts) as k from events group by all"""
ORACLES["normalise_claims"] = f"""with t as ({EVIDENCE}) select doc_id, coalesce(c2pa_agent, c2pa_generator) as c2pa_agent,
 c2pa_source, coalesce(c2pa_generator, c2pa_agent) as c2pa_generator, case when doc_id % 7 <> 0 then c2pa_when end as c2pa_when,
 filename as c2pa_claim_generator from t"""
ORACLES["pdf_info"] = """select doc_id, 'Maker ' || (doc_id % 3) as producer, 'for ' || lang as creator,
 case when doc_id % 2 = 0 then 'Helvetica-' else 'ArialMT+' end as fonts from documents"""

# --- functions
ORACLES["content_sha256"] = "select doc_id, sha256(text) as sha256 from documents"
ORACLES["file_id"] = "select doc_id, substr(sha256(text), 1, 16) as file_id from documents"
ORACLES["hamming_hex"] = """select doc_id, bit_count(xor(('0x' || substr(md5(text), 1, 16))::ubigint,
 ('0x' || substr(md5(text), 17, 16))::ubigint))::int as distance from documents"""
ORACLES["luma"] = """select doc_id, (((doc_id % 256) * 19595 + (n_chars % 256) * 38470 + ((doc_id * 7 + n_chars) % 256) * 7471 + 32768) >> 16) as gray from documents"""
ORACLES["simhash64"] = f"with {MARKS} select doc_id, format('{{:016x}}', phash) as simhash from documents left join marks using (doc_id)"
ORACLES["sorted_distinct"] = """select doc_id, md5(array_to_string(list_sort(list_distinct(string_split(text, ' '))), '|')) as words_md5 from documents"""

CELLS = """ cells as (select vec_id, label, p, p // 8 as y, p % 8 as x, v from (
   select vec_id, label, unnest(generate_series(0, 63)) as p, unnest(embedding)::double as v from embeddings))"""


def _bits_hex(name: str, bits: str, source: str, digits: int = 16) -> str:
    return f"select vec_id, format('{{:0{digits}x}}', sum(case when {bits} then 1::ubigint << shift::ubigint else 0::ubigint end)::ubigint) as {name} from {source} group by vec_id"


ORACLES["ahash"] = f"with {CELLS}, m as (select vec_id, sum(v) / 64 as mean from cells group by vec_id), b as (select c.vec_id, v, mean, (63 - p)::int as shift from cells c join m using (vec_id)) " + _bits_hex("ahash", "v > mean", "b")
ORACLES["dhash"] = f"with {CELLS}, b as (select l.vec_id, l.v as lv, r.v as rv, (55 - (l.y * 7 + l.x))::int as shift from cells l join cells r on l.vec_id = r.vec_id and l.p + 1 = r.p and l.y = r.y) " + _bits_hex("dhash", "rv > lv", "b", 14)
_PHASH = f"""{CELLS},
 down as (select vec_id, u, x, sum(v * 2 * cos(pi() * u * (2 * y + 1) / 16)) as s from cells, range(8) t(u) group by all),
 coef as (select vec_id, u, w, sum(s * 2 * cos(pi() * w * (2 * x + 1) / 16)) as c from down, range(8) t(w) group by all),
 med as (select vec_id, quantile_cont(c, 0.5) as m from coef group by vec_id),
 b as (select vec_id, c, m, (63 - (u * 8 + w))::int as shift from coef join med using (vec_id))"""
ORACLES["phash"] = f"with {_PHASH} " + _bits_hex("phash", "c > m", "b")
ORACLES["whash"] = f"""with {CELLS}, band as (select vec_id, y // 2 as r, x // 2 as q, avg(v) as c from cells group by all),
 med as (select vec_id, quantile_cont(c, 0.5) as m from band group by vec_id),
 b as (select vec_id, c, m, (15 - (r * 4 + q))::int as shift from band join med using (vec_id)) """ + _bits_hex("whash", "c > m", "b", 4)

# --- grids
ORACLES["min_block_std"] = f"""with {CELLS},
 two as (select vec_id, min(s) as m from (select vec_id, y // 2, x // 2, stddev_pop(v) as s from cells group by all) group by vec_id),
 four as (select vec_id, min(s) as m from (select vec_id, y // 4, x // 4, stddev_pop(v) as s from cells group by all) group by vec_id),
 whole as (select vec_id, stddev_pop(v) as m from cells group by vec_id)
 select vec_id, round(two.m, 6) as block_2, round(four.m, 6) as block_4, round(whole.m, 6) as block_16 from two join four using (vec_id) join whole using (vec_id)"""
ORACLES["min_block_std_series"] = """with placed as (select user_id, value, row_number() over (partition by user_id order by ts) - 1 as place from events),
 blocks as (select user_id, place // 8 as b, stddev_pop(value) as s, count(*) as n from placed group by all),
 least_std as (select user_id, min(s) as m from blocks where n = 8 group by user_id),
 whole as (select user_id, stddev_pop(value) as s from events group by user_id)
 select user_id, round(coalesce(m, s), 6) as min_std from whole left join least_std using (user_id)"""
ORACLES["median_residual"] = f"""with {CELLS}, near as (select c.vec_id, c.p, any_value(c.v) as v, median(n.v) as m
   from cells c, range(-1, 2) a(dy), range(-1, 2) b(dx), cells n where n.vec_id = c.vec_id
   and n.p = least(greatest(c.y + dy, 0), 7) * 8 + least(greatest(c.x + dx, 0), 7) group by all)
 select vec_id, round(avg(abs(v - m)), 4) as residual from near group by vec_id"""
_EDGES = f"""{CELLS}, edges as (select vec_id, p, y, x, sqrt(gx * gx + gy * gy) as e from (select *,
   (coalesce(lead(v) over r, v) - coalesce(lag(v) over r, v)) / case when x in (0, 7) then 1 else 2 end as gx,
   (coalesce(lead(v) over k, v) - coalesce(lag(v) over k, v)) / case when y in (0, 7) then 1 else 2 end as gy
   from cells window r as (partition by vec_id, y order by x), k as (partition by vec_id, x order by y)))"""
ORACLES["edge_magnitude"] = f"with {_EDGES} select vec_id, p as cell, round(e, 6) as edge from edges"


def _shift(cells: str, value: str, back: int) -> str:
    """Best shift of each grid against the one `back` ids later; `moved` and `fixed` name the value columns."""
    return f"""select m.vec_id, dy, dx, round(sum(pow(m.{value} - f.{value}, 2)) / 64, 12) as err
   from {cells} m, range(-3, 4) a(dy), range(-3, 4) b(dx), {cells} f
   where f.vec_id = m.vec_id + {back} and f.y = (m.y + dy + 8) % 8 and f.x = (m.x + dx + 8) % 8 group by all"""


ORACLES["best_shift"] = f"""with {CELLS}, trials as ({_shift('cells', 'v', 1)})
 select vec_id, dy, dx, round(sqrt(dy * dy + dx * dx), 6) as distance from trials
 where vec_id + 2 in (select vec_id from embeddings)
 qualify row_number() over (partition by vec_id order by err, dy, dx) = 1"""

# --- rules: condition, confidence and basis of each, over the evidence with derived columns
FACTS = f"""t as ({EVIDENCE}), declared as (select *, case when position('.' in filename) = 0 then 'unknown'
   when lower(regexp_extract(filename, '([^.]*)$', 1)) = 'jpg' then 'jpeg'
   else coalesce(nullif(lower(regexp_extract(filename, '([^.]*)$', 1)), ''), 'unknown') end as declared_format from t),
 facts as (select *, actual_format <> 'unknown' and declared_format <> 'unknown' and actual_format <> declared_format as mismatch,
   {_EXPOSURE} as exposure from declared),
 judged as (select *, coalesce(exif_present and exif_make <> '' and exif_model <> '' and exposure is not null
   and exif_fnumber is not null and exif_iso is not null, false) as camera from facts)"""
RULES = {
    "openai_generation": (
        "c2pa_present and (coalesce(nullif(c2pa_agent, ''), c2pa_generator, '') ilike '%gpt%' or coalesce(nullif(c2pa_agent, ''), c2pa_generator, '') ilike '%openai%' or coalesce(c2pa_source, '') ilike '%trainedalgorithmicmedia%')",
        "'high'",
        "concat_ws('|', case when actual_format = 'png' then 'C2PA manifest embedded (PNG caBX)' else 'C2PA manifest embedded (JPEG APP11 JUMBF)' end, 'softwareAgent: ' || nullif(c2pa_agent, ''), 'digitalSourceType: ' || nullif(c2pa_source, ''))",
    ),
    "whatsapp_transmission": (
        "actual_format = 'jpeg' and progressive and quant_identical and not exif_present and not icc_present", "'high'",
        "'progressive JPEG (SOF2)|luma and chroma quantization tables byte-identical|no EXIF present|no ICC profile present'",
    ),
    "android_screenshot": (
        "actual_format = 'png' and exif_present and exif_software ilike '%android%'", "'high'",
        "concat_ws('|', 'PNG eXIf chunk with Software: ' || exif_software, case when exif_original <> '' then 'DateTimeOriginal present' end, case when exif_image_id <> '' then 'ImageUniqueID present' end)",
    ),
    "android_camera_reshared": (
        "actual_format = 'jpeg' and icc_copyright ilike '%google inc%' and not exif_present and not progressive", "'high'",
        "'ICC profile copyright = ''' || icc_copyright || '''|EXIF stripped|baseline JPEG'",
    ),
    "direct_phone_camera": (
        "camera", "case when exif_thumbnail then 'high' else 'medium' end",
        "concat_ws('|', 'Make/Model: ' || exif_make || ' / ' || exif_model, 'exposure triangle present: ' || exposure || ', f/' || exif_fnumber::varchar || ', ISO ' || exif_iso, 'SubSecTime: ' || nullif(exif_subsec, ''), case when exif_gps then 'GPS IFD present' end, case when exif_thumbnail then 'thumbnail IFD present' end)",
    ),
    "near_lossless_export": (
        "actual_format = 'jpeg' and quant_all_le1 and not exif_present and not icc_present", "'medium'",
        "concat_ws('|', 'all-1 quantization tables (quality ~100)', 'no EXIF present', 'no ICC profile present', case when mismatch then 'format/extension mismatch (declared ' || declared_format || ', actual ' || actual_format || ')' end)",
    ),
    "screen_capture": (
        "min_flat_std = 0", "'high'",
        "'flat region with standard deviation exactly 0.000 (min == max) — framebuffer capture'",
    ),
    "reportlab_programmatic_pdf": (
        "actual_format = 'pdf' and pdf_producer ilike '%reportlab%'", "'high'",
        "concat_ws('|', 'Producer: ' || pdf_producer, 'non-embedded base-14 fonts: ' || nullif(array_to_string(list_sort(list_distinct(list_filter([case when font_one <> 'ArialMT' then font_one end, case when not font_two_embedded and font_two <> 'Roboto' then font_two end], lambda f: f is not null))), ', '), ''))",
    ),
    "browser_print_to_pdf": (
        "actual_format = 'pdf' and pdf_producer ilike '%skia/pdf%' and pdf_creator ilike '%chromium%'", "'high'",
        "concat_ws('|', 'Producer: ' || pdf_producer, 'Creator: ' || pdf_creator, case when font_two_embedded then 'embedded subsetted fonts: ' || font_two end)",
    ),
    "ilovepdf_compression": (
        "actual_format = 'pdf' and pdf_producer ilike '%ilovepdf%'", "'high'",
        "'Producer: ' || pdf_producer || ' (overwrites the original producer string)'",
    ),
}
BADGE_OF = {
    "openai_generation": "ai-generator", "whatsapp_transmission": "whatsapp", "android_screenshot": "android",
    "android_camera_reshared": "android", "direct_phone_camera": "camera", "near_lossless_export": "export-tool",
    "screen_capture": "screen-capture", "reportlab_programmatic_pdf": "pdf", "browser_print_to_pdf": "pdf",
    "ilovepdf_compression": "pdf",
}
ORACLES["classify_all"] = f"with {FACTS} select doc_id, concat_ws('|', " + ", ".join(
    f"case when {cond} then '{name}:' || {conf} end" for name, (cond, conf, _) in RULES.items()) + ") as matches from judged"
_BADGES = "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(
    f"case when {cond} then '{BADGE_OF[name]}' end" for name, (cond, _, _) in RULES.items()) + "], lambda b: b is not null))), '|')"
ORACLES["badges"] = f"with {FACTS} select doc_id, {_BADGES} as badges from judged"
for _key, _name in {
    "rule_openai": "openai_generation", "rule_whatsapp": "whatsapp_transmission", "rule_screenshot": "android_screenshot",
    "rule_reshared": "android_camera_reshared", "rule_camera": "direct_phone_camera", "rule_lossless": "near_lossless_export",
    "rule_screen": "screen_capture", "rule_reportlab": "reportlab_programmatic_pdf", "rule_browser": "browser_print_to_pdf",
    "rule_ilovepdf": "ilovepdf_compression",
}.items():
    _cond, _conf, _basis = RULES[_name]
    ORACLES[_key] = f"with {FACTS} select doc_id, {_conf} as confidence, {_basis} as basis from judged where {_cond}"

_VERDICT = "case when c2pa_present or camera then 'VERIFIED_ORIGIN' when {matched} then 'DERIVED' else 'NO_RECORD' end"
ORACLES["verdict"] = f"with {FACTS} select doc_id, {_VERDICT.format(matched='doc_id % 5 > 1')} as verdict from judged"
ORACLES["verdict_statement"] = f"""with {FACTS} select doc_id, case
 when c2pa_present then 'Cryptographically signed' || coalesce(' by ' || coalesce(nullif(c2pa_generator, ''), nullif(c2pa_agent, '')), '') || '.'
   || coalesce(' Declared as AI-generated (' || nullif(c2pa_source, '') || ').', '') || coalesce(' Signed ' || substr(c2pa_when, 1, 10) || '.', '')
 when camera then 'Captured on ' || exif_make || ' ' || exif_model || '. ' || concat_ws(', ', 'ISO ' || nullif(exif_iso, 0), exposure, 'f/' || exif_fnumber::varchar)
   || ' — consistent with a coherent exposure triangle.' || case when exif_thumbnail then ' Thumbnail IFD present.' else '' end
 when doc_id % 5 > 1 then 'Matches ''f' || (doc_id - 1) || ''' uploaded earlier this session (' || case when doc_id % 2 = 0 then 'cropped, screenshot' else 're-encoded' end
   || '; ' || case when doc_id % 3 = 1 then (doc_id % 11) || ' matching local features (ORB)' else 'phash distance ' || (doc_id % 11) end || ').'
 else 'No chain of custody found for this file. Content credentials are commonly removed by screenshots, messaging apps, and re-encoding.' end as statement from judged"""
_PARTS = [
    ("valid_c2pa_manifest_present", 40, "c2pa_present"),
    ("full_camera_exif_coherent_exposure_triangle", 25, "camera"),
    ("thumbnail_ifd_present", 10, "exif_thumbnail"),
    ("icc_profile_known_vendor_pipeline", 10, "icc_present and icc_copyright <> ''"),
    ("no_format_extension_mismatch", 10, "not mismatch"),
    ("no_trailing_bytes_after_eoi", 5, "trailing_bytes = 0"),
]
_SCORE = "least(100, " + " + ".join(f"case when {c} then {n} else 0 end" for _, n, c in _PARTS) + ")"
ORACLES["trace_score"] = f"with {FACTS} select doc_id, {_SCORE} as score, 100 as max_value, concat_ws('|', " + ", ".join(
    f"case when {c} then '{k}={n}' end" for k, n, c in _PARTS) + ") as breakdown from judged"
ORACLES["score_label"] = """select doc_id, 'Trace Score: ' || v || '/100 — ' || case when v = 0 then 'no verifiable provenance data survives in this file.'
 when v < 30 then 'most provenance data has been stripped from this file.' when v < 70 then 'partial provenance history survives.'
 else 'strong verifiable history survives.' end as label from (select doc_id, doc_id % 101 as v from documents)"""
ORACLES["detect_transformations"] = f"with {CHANGES} select session_id, arrival, transformations from changed where parent_file_id is not null"
_HITS = " + ".join(f"case when {cond} then 1 else 0 end" for cond, _, _ in RULES.values())
ORACLES["assemble_record"] = f"""with {FACTS} select j.doc_id, sha256(d.text) as sha256, d.n_chars as width, exif_make as make,
 icc_copyright as copyright, c2pa_agent as software_agent, trailing_bytes as trailing_byte_count, min_flat_std as min_flat_region_std,
 {_HITS} as rules_hit, 0 as changes, exif_present::int as exif_present
 from (select * from judged) j join (select doc_id, text, n_chars from documents) d on d.doc_id = j.doc_id"""

# --- matching
ORACLES["prior_candidates"] = f"""with {UPLOADS} select session_id, file_id, arrival,
 lead(arrival) over (partition by session_id, file_id order by arrival) as replaced_at,
 (select count(distinct p.file_id) from up p where p.session_id = up.session_id and p.arrival < up.arrival) as candidates from up"""
_VALUES = f"""{LIVES}, vals as (select session_id, phash, count(*) as copies, min(arrival) as first from lives where phash is not null group by all),
 near as (select a.session_id, a.phash as h, b.phash as nh, bit_count(xor(a.phash, b.phash)) as distance, a.copies, b.copies as near_copies, b.first as near_first
   from vals a join vals b on a.session_id = b.session_id and b.first < a.first where bit_count(xor(a.phash, b.phash)) <= 10)"""
ORACLES["hamming_join"] = f"""with {_VALUES} select session_id, format('{{:016x}}', h) as hash, format('{{:016x}}', nh) as near_hash, distance, copies, near_copies from near"""
ORACLES["argmin_stable"] = f"""with {_VALUES} select session_id, format('{{:016x}}', h) as hash, format('{{:016x}}', nh) as near_hash, distance from near
 qualify row_number() over (partition by session_id, h order by distance, near_first) = 1"""
_GOOD = """ d as (select vec_id, vec_id // 500 as session_id, (vec_id // 100) * 10 + label as file_id,
   list_reduce(list_transform(embedding, lambda v: case when v > 0 then 1::ubigint else 0::ubigint end), lambda a, b: a * 2 + b) as bits from (select * from embeddings)),
 f as (select session_id, file_id, min(vec_id) as first, count(*) as n from d group by all),
 near as (select a.session_id, a.file_id, b.file_id as parent_file_id, a.vec_id, bit_count(xor(a.bits, b.bits)) as dist,
   row_number() over (partition by a.vec_id, b.file_id order by bit_count(xor(a.bits, b.bits))) as rn
   from d a join d b on a.session_id = b.session_id join f fa on fa.session_id = a.session_id and fa.file_id = a.file_id
   join f fb on fb.session_id = b.session_id and fb.file_id = b.file_id where fb.first < fa.first and fa.n > 1 and fb.n > 1),
 tests as (select session_id, file_id, parent_file_id, vec_id, min(dist) filter (where rn = 1) as d1, min(dist) filter (where rn = 2) as d2 from near where rn <= 2 group by all),
 goods as (select session_id, file_id, parent_file_id, count(*) as good from tests where d1 < 0.75 * d2 group by all)"""
ORACLES["knn_ratio_match"] = f"with {_GOOD} select * from goods"
ORACLES["local_feature_match"] = f"""with {_GOOD} select g.session_id, fa.first as arrival, parent_file_id, good as metric from goods g
 join f fa on fa.session_id = g.session_id and fa.file_id = g.file_id join f fb on fb.session_id = g.session_id and fb.file_id = g.parent_file_id
 qualify row_number() over (partition by g.session_id, g.file_id order by good desc, fb.first) = 1"""
ORACLES["argmax_stable"] = f"""with {_GOOD} select session_id, file_id, good, parent_file_id from goods
 qualify row_number() over (partition by session_id, file_id order by good desc, parent_file_id) = 1"""
ORACLES["best_match"] = f"with {MATCHES} select session_id, arrival, parent_file_id, parent_order, metric, 'phash' as match_type from ranked"
ORACLES["best_match_grids"] = f"""with {_PHASH}, ph as (select vec_id, sum(case when c > m then 1::ubigint << shift::ubigint else 0::ubigint end)::ubigint as h from b group by vec_id),
 rises as (select l.vec_id, l.v as lv, r.v as rv, (55 - (l.y * 7 + l.x))::int as shift from cells l join cells r on l.vec_id = r.vec_id and l.p + 1 = r.p and l.y = r.y),
 dh as (select vec_id, sum(case when rv > lv then 1::ubigint << shift::ubigint else 0::ubigint end)::ubigint as h from rises group by vec_id),
 marks as (select vec_id, 0 as rank, h from ph union all select vec_id, 1, h from dh),
 m as (select marks.*, label from marks join embeddings using (vec_id))
 select c.label as session_id, c.vec_id as arrival, p.vec_id as parent_file_id, p.vec_id as parent_order, bit_count(xor(c.h, p.h)) as metric,
  case c.rank when 0 then 'phash' else 'dhash' end as match_type
 from m c join m p on c.label = p.label and c.rank = p.rank and p.vec_id < c.vec_id where bit_count(xor(c.h, p.h)) <= 20
 qualify row_number() over (partition by c.label, c.vec_id order by bit_count(xor(c.h, p.h)), p.vec_id, c.rank) = 1"""
ORACLES["attach_parent"] = f"with {CHANGES} select session_id, arrival, file_id, parent_filename, parent_sha256, pw as parent_width from pairs"
ORACLES["exact_duplicates"] = f"""with {UPLOADS} select session_id, sha256, count(*) as copies, min(arrival) as first_arrival, max(arrival) as last_arrival
 from up group by all having count(*) > 1"""
ORACLES["first_last_wins"] = "select user_id, event_type, arg_min(value, ts) as first_value, arg_max(value, ts) as last_value from events group by all"
ORACLES["session_order"] = f"with {UPLOADS} select session_id, arrival, filename, row_number() over (partition by session_id order by arrival) - 1 as place from up"

# --- graph
ORACLES["session_nodes"] = f"""with {FACTS} select session_id, doc_id::varchar as file_id, arrival, filename, {_VERDICT.format(matched='false')} as verdict,
 {_BADGES} as badges, {_SCORE} as trace_score from judged"""
ORACLES["valid_edges"] = f"""with {UPLOADS}, res as (select *, substr(sha256(regexp_replace(text, '\\s+$', '')), 1, 16) as parent_file_id from up
   qualify row_number() over (partition by session_id, file_id order by arrival desc) = 1)
 select session_id, file_id, parent_file_id from res r where exists (select 1 from res p where p.session_id = r.session_id and p.file_id = r.parent_file_id)"""
ORACLES["session_edges"] = f"with {RESULTS} select * from edges"
ORACLES["lineage_roots"] = f"""with {RESULTS}, free as (select session_id, file_id from res r where not exists (select 1 from edges e where e.session_id = r.session_id and e.target = r.file_id))
 select * from free union all select session_id, file_id from res where session_id not in (select session_id from free)"""
ORACLES["lineage_depth"] = f"""with recursive {RESULTS},
 link as (select r.session_id, r.file_id, r.arrival, e.source as up from res r left join edges e on e.session_id = r.session_id and e.target = r.file_id),
 walk as (select session_id, file_id, file_id as at, 0 as hops, [file_id] as seen from link
  union all select w.session_id, w.file_id, l.up, w.hops + 1, list_append(w.seen, l.up) from walk w join link l on l.session_id = w.session_id and l.file_id = w.at
  where l.up is not null and not list_contains(w.seen, l.up)),
 rooted as (select distinct session_id from link where up is null),
 picked as (select w.session_id, w.file_id, w.hops from walk w join link l on l.session_id = w.session_id and l.file_id = w.at
  qualify row_number() over (partition by w.session_id, w.file_id order by l.up is null desc, l.arrival) = 1)
 select session_id, file_id, case when session_id in (select session_id from rooted) then hops else 0 end as depth from picked"""
ORACLES["stream_match_replay"] = ORACLES["best_match"]
ORACLES["stateful_match"] = ORACLES["best_match"]
ORACLES["incremental_graph"] = ORACLES["session_edges"]
ORACLES["streamed_lineage"] = ORACLES["lineage_depth"]
_SHIFTED = f"""{_EDGES}, red as ({_shift('edges', 'e', 1)}),
 blue as (select m.vec_id - 2 as vec_id, dy, dx, round(sum(pow(m.e - f.e, 2)) / 64, 12) as err
   from edges m, range(-3, 4) a(dy), range(-3, 4) b(dx), edges f
   where f.vec_id = m.vec_id - 1 and f.y = (m.y + dy + 8) % 8 and f.x = (m.x + dx + 8) % 8 group by all),
 best as (select vec_id, sqrt(dy * dy + dx * dx) as d, 1 as c from red qualify row_number() over (partition by vec_id order by err, dy, dx) = 1
   union all select vec_id, sqrt(dy * dy + dx * dx), 2 from blue qualify row_number() over (partition by vec_id order by err, dy, dx) = 1),
 mis as (select vec_id, round(sum(d) / 2, 4) as misalignment from best group by vec_id having count(*) = 2)"""
ORACLES["channel_misalignment"] = f"with {_SHIFTED} select * from mis"
ORACLES["grid_stats"] = f"""with {_SHIFTED}, near as (select c.vec_id, c.p, any_value(c.v) as v, median(n.v) as m
   from cells c, range(-1, 2) a(dy), range(-1, 2) b(dx), cells n where n.vec_id = c.vec_id
   and n.p = least(greatest(c.y + dy, 0), 7) * 8 + least(greatest(c.x + dx, 0), 7) group by all),
 noise as (select vec_id, round(avg(abs(v - m)), 4) as mean_residual_noise from near group by vec_id)
 select vec_id, mean_residual_noise, misalignment, 'Pixel statistics are logged for transparency only. They do not drive any verdict or score.' as note
 from noise left join mis using (vec_id)"""

# --- damaged bytes, written tables, shared shingles
_JPEG, _DAMAGE = "doc_id % 2 = 0", "((doc_id // 2) % 6)"
ORACLES["damaged_evidence"] = f"""select doc_id, case when {_JPEG} then 'jpeg' else 'pdf' end as actual_format, ({_JPEG})::int as exif_present,
 case when {_JPEG} and {_DAMAGE} <> 1 then case when {_DAMAGE} = 3 then '' else 'TECNO' end end as exif_make,
 case when {_JPEG} and {_DAMAGE} <> 1 then 'KL' || (doc_id % 4) end as exif_model,
 case when {_JPEG} and {_DAMAGE} <> 1 then case when doc_id % 4 = 0 then 'Android 13' else 'Camera 1.0' end end as exif_software,
 case when {_JPEG} and {_DAMAGE} not in (1, 2) then case when {_DAMAGE} = 5 then 2147483648 + doc_id else 100 + doc_id % 7 * 50 end end as exif_iso,
 case when {_JPEG} and {_DAMAGE} not in (1, 2) then '1/' || (25 + doc_id % 3) end as exposure_text,
 case when {_JPEG} and {_DAMAGE} not in (1, 2) then 'a profile' end as icc_description,
 case when {_JPEG} then '(c) ' || source end as icc_copyright,
 case when not {_JPEG} then md5(case when {_DAMAGE} = 1 then 'Maker (of (nested)) ) ' || repeat('x(', length(text)) else nullif(text, '') end) end as producer_md5,
 case when not {_JPEG} and {_DAMAGE} <> 3 then 'unfinished ' end as pdf_creator from documents"""
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
ORACLES["oversize_rejects"] = f"""select unnest(string_split('{_TABLES}', ' ')) || '.parquet' as filename, '413' as reason, null::varchar as starts"""
ORACLES["written_results"] = f"""with {UPLOADS} select session_id, arrival, file_id, sha256, filename, width, height from up
 qualify row_number() over (partition by session_id, file_id order by arrival desc) = 1"""
ORACLES["written_graph"] = f"""with {RESULTS}, e as (select session_id, count(*) as edges from edges group by session_id)
 select session_id, count(*) as nodes, coalesce(max(e.edges), 0) as edges from res left join e using (session_id) group by session_id"""
ORACLES["shared_shingle_match"] = """with texts as (select min(doc_id) as doc_id, count(*) as copies, string_split(text, ' ') as w from documents group by text),
 grams as (select doc_id, copies, unnest(list_distinct(list_transform(generate_series(1, len(w) - 4),
   lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]))) as g from texts where len(w) >= 5)
 select a.doc_id, b.doc_id as other_id, any_value(a.copies) as copies, any_value(b.copies) as other_copies, count(*) as shared
 from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id having count(*) >= 25"""
_SOUND = f"{_JPEG} and {_DAMAGE} in (0, 4, 5) and doc_id % 5 <> 0"
ORACLES["analyze_corpus"] = f"""with files as (select *, case when {_JPEG} then concat_ws('|', text, doc_id % 4000, {_DAMAGE}, doc_id % 420)
   when {_DAMAGE} = 1 then 'nested ' || length(text) when {_DAMAGE} = 3 then 'open ' || text else 'hex ' || text end as bytes from documents),
 seen as (select *, row_number() over (partition by lang, {_JPEG}, bytes order by doc_id) > 1 as again from files)
 select lang as session_id, doc_id as arrival, 'doc-' || doc_id || case when {_JPEG} and doc_id % 7 <> 0 then '.JPG' else '.pdf' end as filename,
 case when {_SOUND} then 'VERIFIED_ORIGIN' when again then 'DERIVED' else 'NO_RECORD' end as verdict,
 case when {_SOUND} then 'Captured on TECNO KL' || (doc_id % 4) || '. ISO ' || case when {_DAMAGE} = 5 then 2147483648 + doc_id else 100 + doc_id % 7 * 50 end
   || ', 1/' || (25 + doc_id % 3) || ', f/1.85 — consistent with a coherent exposure triangle.' end as statement,
 (5 + case when {_JPEG} and doc_id % 7 = 0 then 0 else 10 end + case when {_JPEG} then 10 else 0 end + case when {_SOUND} then 25 else 0 end)::int as trace_score,
 case when {_SOUND} then 'direct_phone_camera' else '' end as rules, null::varchar as reason from seen"""
