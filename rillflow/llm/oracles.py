"""The same results in SQL, by other ways: brute force and recursion instead of the operators' methods."""

from __future__ import annotations

_OUTER = r"^[\s\x{FEFF}\x{200B}\x{2060}\x{A0}]+|[\s\x{FEFF}\x{200B}\x{2060}\x{A0}]+$"


def _clean(c: str) -> str:
    return f"lower(regexp_replace({c}, '{_OUTER}', '', 'g'))"


def _name(c: str) -> str:
    plain = rf"regexp_replace(lower(url_decode(replace(regexp_replace({c}, '{_OUTER}', '', 'g'), '+', '%2B'))), '\.(mp4|webm|mkv|mov|avi|m4v)$', '')"
    return f"nullif(regexp_replace({plain}, '^.*/(?:videos|proxy_[^/]+)/', ''), '')"


_VIDEOS = f"""
stored AS (SELECT DISTINCT extra_info.video_id AS v, {_name('extra_info.video_id')} AS id FROM corpus_rows WHERE extra_info.video_id IS NOT NULL),
content AS (
  SELECT DISTINCT {_name('video_id')} AS id, lower(trim(content_sha1)) AS sha FROM video_files
  WHERE n_bytes > 0 AND trim(content_sha1) <> '' AND lower(trim(content_sha1)) <> 'da39a3ee5e6b4b0d3255bfef95601890afd80709'),
edge AS (SELECT DISTINCT p.id AS a, q.id AS b FROM content p JOIN content q ON p.sha = q.sha AND p.id <> q.id),
reach(id, label) AS (SELECT a, a FROM edge UNION SELECT e.b, r.label FROM reach r JOIN edge e ON e.a = r.id),
component AS (SELECT id, min(label) AS video FROM reach GROUP BY id),
named AS (SELECT s.v, coalesce(c.video, s.id) AS video FROM stored s LEFT JOIN component c ON c.id = s.id WHERE s.id IS NOT NULL)
"""

_RATE = "CASE WHEN extra_info.solve_rate >= 0 AND extra_info.solve_rate <= 1 AND NOT isnan(extra_info.solve_rate) THEN extra_info.solve_rate END"

_CUTS = f"""
rated AS (SELECT {_clean('data_source')} AS data_source, {_RATE} AS rate FROM corpus_rows),
counted AS (SELECT data_source, rate, count(*) AS n FROM rated WHERE rate IS NOT NULL GROUP BY ALL),
cuts AS (
  SELECT data_source, rate AS cutoff, sum(n) OVER (PARTITION BY data_source ORDER BY rate) AS kept, sum(n) OVER (PARTITION BY data_source) AS known FROM counted
  UNION ALL SELECT data_source, NULL, 0, sum(n) FROM counted GROUP BY data_source)
"""

_WORDS = rf"""
msg AS (
  SELECT row_id, video, split, data_source, question_id, string_split_regex(t, '[^\p{{L}}\p{{N}}]+') AS raw FROM (
    SELECT c.row_id, n.video, {_clean('c.split')} AS split, {_clean('c.data_source')} AS data_source, {_clean('c.extra_info.question_id')} AS question_id,
      replace(array_to_string(list_transform(list_filter(c.prompt, lambda m: lower(trim(m.role)) = 'user'), lambda m: coalesce(m.content, '')), chr(10)), '<video>', ' ') AS u, lower(u) AS t
    FROM corpus_rows c JOIN named n ON n.v = c.extra_info.video_id)),
word AS (SELECT row_id, video, w, count(*) AS k FROM (SELECT row_id, video, unnest(raw) AS w FROM msg) WHERE w <> '' GROUP BY ALL),
size AS (SELECT row_id, sum(k) AS n FROM word GROUP BY row_id),
both_ AS (SELECT p.row_id AS a, q.row_id AS b, sum(least(p.k, q.k)) AS common FROM word p JOIN word q ON p.video = q.video AND p.w = q.w AND p.row_id < q.row_id GROUP BY ALL),
near AS (
  SELECT a AS row_id_a, b AS row_id_b FROM both_ JOIN size x ON x.row_id = a JOIN size y ON y.row_id = b WHERE common >= 0.75 * (x.n + y.n - common)
  UNION SELECT p.row_id, q.row_id FROM msg p JOIN msg q ON p.video = q.video AND p.row_id < q.row_id
  WHERE p.row_id NOT IN (SELECT row_id FROM size) AND q.row_id NOT IN (SELECT row_id FROM size))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH {_CUTS} SELECT data_source FROM (
            SELECT t.data_source, min(abs(c.kept::DOUBLE / c.known - t.target_keep)) AS off FROM keep_targets t LEFT JOIN cuts c USING (data_source) GROUP BY t.data_source)
            WHERE off IS NULL OR off > 0.02 + 1e-9""",
        "p1_cutoffs": f"""WITH {_CUTS} SELECT data_source, target_keep, cutoff, CAST(coalesce(known, 0) AS BIGINT) AS known_rows, CAST(coalesce(kept, 0) AS BIGINT) AS kept_rows, kept::DOUBLE / known AS kept_share
            FROM (SELECT t.*, c.cutoff, c.kept, c.known, row_number() OVER (PARTITION BY t.data_source ORDER BY round(abs(c.kept::DOUBLE / c.known - t.target_keep), 12), c.kept) AS r
                  FROM keep_targets t LEFT JOIN cuts c USING (data_source)) WHERE r = 1""",
        "p2_found": f"""WITH RECURSIVE {_VIDEOS} SELECT min(n.v) AS video_id FROM corpus_rows c JOIN named n ON n.v = c.extra_info.video_id GROUP BY n.video HAVING count(*) > 15""",
        "p2_report": f"""WITH RECURSIVE {_VIDEOS} SELECT min(n.v) AS video_id, count(*) AS total, least(count(*), 15) AS kept, count(*) - least(count(*), 15) AS lost
            FROM corpus_rows c JOIN named n ON n.v = c.extra_info.video_id GROUP BY n.video""",
        "p2_kept": f"""WITH RECURSIVE {_VIDEOS} SELECT row_id, video_id, rate FROM (
            SELECT c.row_id, c.extra_info.video_id AS video_id, {_RATE} AS rate, n.video,
              row_number() OVER (PARTITION BY n.video ORDER BY coalesce(1 - abs(2 * ({_RATE}) - 1), -1) DESC, c.row_id) AS r
            FROM corpus_rows c LEFT JOIN named n ON n.v = c.extra_info.video_id) WHERE r <= 15 OR video IS NULL""",
        "p3_found": f"""WITH RECURSIVE {_VIDEOS} SELECT p.v AS video_id_a, q.v AS video_id_b FROM named p JOIN named q ON p.video = q.video AND p.v < q.v""",
        "p3_videos": f"""WITH RECURSIVE {_VIDEOS} SELECT v AS video_id, min(v) OVER (PARTITION BY video) AS first_id, count(*) OVER (PARTITION BY video) AS names FROM named""",
        "p4_goals": f"""SELECT t.difficulty_band, t.num_hops, coalesce(n, 0) AS available, round(t.target_share * 0.2 * (SELECT count(*) FROM corpus_rows), 6) AS wanted,
            coalesce(n, 0) + 1e-9 < t.target_share * 0.2 * (SELECT count(*) FROM corpus_rows) AS short, true AS near_plan FROM sample_targets t LEFT JOIN (
            SELECT {_clean('extra_info.difficulty_band')} AS difficulty_band, extra_info.num_hops AS num_hops, count(*) AS n FROM corpus_rows GROUP BY ALL) c USING (difficulty_band, num_hops)""",
        "p4_found": f"""SELECT t.difficulty_band, t.num_hops FROM sample_targets t LEFT JOIN (
            SELECT {_clean('extra_info.difficulty_band')} AS difficulty_band, extra_info.num_hops AS num_hops, count(*) AS n FROM corpus_rows GROUP BY ALL) c USING (difficulty_band, num_hops)
            WHERE coalesce(n, 0) + 1e-9 < t.target_share * 0.2 * (SELECT count(*) FROM corpus_rows)""",
        "p5_found": f"WITH RECURSIVE {_VIDEOS}, {_WORDS} SELECT row_id_a, row_id_b FROM near",
        "p5_groups": f"""WITH RECURSIVE {_VIDEOS}, {_WORDS}, tie AS (SELECT row_id_a AS a, row_id_b AS b FROM near UNION ALL SELECT row_id_b, row_id_a FROM near),
            hop(row_id, root) AS (SELECT DISTINCT a, a FROM tie UNION SELECT e.b, h.root FROM hop h JOIN tie e ON e.a = h.row_id), grp AS (SELECT row_id, min(root) AS group_id FROM hop GROUP BY row_id),
            cls AS (SELECT row_id, min(row_id) OVER (PARTITION BY video, array_to_string(list_sort(list_filter(raw, lambda w: w <> '')), ' ')) AS class_id FROM msg),
            link AS (SELECT x.class_id, count(DISTINCT y.class_id) AS n FROM tie e JOIN cls x ON x.row_id = e.a JOIN cls y ON y.row_id = e.b WHERE x.class_id <> y.class_id GROUP BY x.class_id)
            SELECT g.row_id, c.class_id, g.group_id, coalesce(l.n, 0) AS n_links FROM grp g JOIN cls c USING (row_id) LEFT JOIN link l USING (class_id)""",
        "p3_checks": """SELECT count(*) AS n_rows, 0::BIGINT AS torn_videos, 0::BIGINT AS unassigned FROM corpus_rows""",
        "p7_checks": """SELECT pack_name, max(capacity_tokens) AS capacity, 0::BIGINT AS overfull, 0::BIGINT AS cut_needlessly, 0::BIGINT AS numbers_missing FROM pack_sizes GROUP BY pack_name""",
        "p6_found": f"""WITH RECURSIVE {_VIDEOS}, {_WORDS},
            held AS (SELECT p.row_id AS t, q.row_id AS e, p.question_id = q.question_id AND p.question_id <> '' AS same FROM msg p JOIN msg q ON p.video = q.video AND p.split = 'train' AND q.split IN ('val', 'validation', 'test')),
            pair AS (SELECT least(t, e) AS row_id_a, greatest(t, e) AS row_id_b, same FROM held)
            SELECT p.row_id_a, p.row_id_b FROM pair p LEFT JOIN near n USING (row_id_a, row_id_b) WHERE p.same OR n.row_id_a IS NOT NULL""",
        "p6_counts": f"""WITH RECURSIVE {_VIDEOS}, {_WORDS},
            held AS (SELECT p.row_id AS t, q.row_id AS e, CASE q.split WHEN 'validation' THEN 'val' ELSE q.split END AS split, q.data_source, coalesce(p.question_id = q.question_id AND p.question_id <> '', false) AS same
                     FROM msg p JOIN msg q ON p.video = q.video AND p.split = 'train' AND q.split IN ('val', 'validation', 'test')),
            hit AS (SELECT h.*, n.row_id_a IS NOT NULL AS near FROM held h LEFT JOIN near n ON n.row_id_a = least(t, e) AND n.row_id_b = greatest(t, e) WHERE h.same OR n.row_id_a IS NOT NULL)
            SELECT split, data_source, count(*) AS pairs, count(DISTINCT e) AS held_rows, count(*) FILTER (same) AS by_question, count(*) FILTER (near) AS by_message FROM hit GROUP BY split, data_source""",
    }
