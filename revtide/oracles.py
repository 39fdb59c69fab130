"""Plain SQL for each named query, to be run by another engine on the same files."""

from __future__ import annotations

ORDERS = """
revisions AS (
  SELECT o_orderkey AS revno, o_orderdate AS commitdate, CAST(o_custkey AS VARCHAR) AS author,
         o_orderpriority AS msg FROM orders),
changes AS (
  SELECT l_orderkey AS revno,
         '/' || p_type || '/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || '_'
           || CAST(p_partkey AS VARCHAR)
           || CASE p_size % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.html' WHEN 2 THEN '.js' ELSE '' END
           AS changedpath,
         CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'N' THEN 'M'
              WHEN l_linestatus = 'F' THEN 'D' ELSE 'R' END AS changetype,
         'F' AS pathtype,
         CAST(l_quantity AS BIGINT) AS linesadded,
         CAST(round(l_discount * 100) AS BIGINT) AS linesdeleted
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""

EVENTS = """
revisions AS (
  SELECT event_id AS revno, ts AS commitdate, CAST(user_id AS VARCHAR) AS author, event_type AS msg
  FROM events),
changes AS (
  SELECT event_id AS revno,
         '/' || event_type || '/k' || regexp_extract(props, '"k": *([0-9]+)', 1) || '.dat' AS changedpath,
         CASE event_type WHEN 'signup' THEN 'A' WHEN 'error' THEN 'D' ELSE 'M' END AS changetype,
         'F' AS pathtype, CAST(trunc(value) AS BIGINT) AS linesadded, CAST(0 AS BIGINT) AS linesdeleted
  FROM events)
"""

# Running series over a per-day table ``daily(g, day, v)``: filler rows, closing row, strip.
FILLED = """
ends AS (SELECT CAST(max(commitdate) AS DATE) + 1 AS end_day FROM revisions),
steps AS (SELECT g, day, v, lag(day) OVER w AS pday, lag(v) OVER w AS pv, lead(day) OVER w AS nday
          FROM trend WINDOW w AS (PARTITION BY g ORDER BY day)),
filled AS (
  SELECT g, day, v FROM steps
  UNION ALL SELECT g, day - 1, pv FROM steps WHERE day - pday > 1
  UNION ALL SELECT g, end_day, v FROM steps, ends WHERE nday IS NULL AND day < end_day),
starts AS (SELECT g, min(day) AS from_day FROM filled WHERE v <> 0 GROUP BY g),
stripped AS (SELECT f.g, f.day, f.v FROM filled f JOIN starts s ON f.g = s.g AND f.day >= s.from_day)
"""


def _o(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join((ORDERS, *ctes)) + body


def _e(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join((EVENTS, *ctes)) + body


DAY = "strftime({}, '%Y-%m-%d')"
NET_DAILY = """
daily AS (SELECT '' AS g, CAST(commitdate AS DATE) AS day, sum(linesadded - linesdeleted) AS d
          FROM revisions JOIN changes USING (revno) GROUP BY 2)"""
RUNNING = """
trend AS (SELECT g, day, CAST(sum(d) OVER (PARTITION BY g ORDER BY day) AS BIGINT) AS v FROM daily)"""
TOP20 = """
spelled AS (SELECT lower(author) AS k, count(*) AS n, arg_min(author, revno) AS author FROM revisions GROUP BY 1),
top20 AS (SELECT author FROM spelled ORDER BY n DESC, author LIMIT 20)"""
# One file's or author's temperature as a fold over its events, straight from the recurrence.
FILE_FOLD = """
hits AS (SELECT changedpath AS k, revno, commitdate,
                row_number() OVER (PARTITION BY changedpath ORDER BY revno, linesadded, linesdeleted) AS i
         FROM changes JOIN revisions USING (revno) WHERE pathtype = 'F'),
fold(k, i, revno, ts, t) AS (
  SELECT k, i, revno, commitdate, CAST(10 AS DOUBLE) FROM hits WHERE i = 1
  UNION ALL
  SELECT h.k, h.i, h.revno, h.commitdate,
         10 + 1.1 + (f.t - 1.1) * exp(-0.0025 * greatest(0, epoch_us(h.commitdate) - epoch_us(f.ts)) / 3.6e9)
  FROM fold f JOIN hits h ON h.k = f.k AND h.i = f.i + 1)"""
AUTHOR_FOLD = """
hits AS (SELECT author AS k, commitdate, row_number() OVER (PARTITION BY author ORDER BY commitdate, revno) AS i
         FROM revisions),
fold(k, i, ts, t) AS (
  SELECT k, i, commitdate, CAST(10 AS DOUBLE) FROM hits WHERE i = 1
  UNION ALL
  SELECT h.k, h.i, h.commitdate,
         10 + 1.1 + (f.t - 1.1) * exp(-0.0025 * (epoch_us(h.commitdate) - epoch_us(f.ts)) / 3.6e9)
  FROM fold f JOIN hits h ON h.k = f.k AND h.i = f.i + 1),
ends AS (SELECT CAST(max(commitdate) AS DATE) + 1 AS end_day FROM revisions),
final AS (SELECT k AS author, i AS commits,
                 1.1 + (t - 1.1) * exp(-0.0025 * (epoch_us(CAST(end_day AS TIMESTAMP)) - epoch_us(ts)) / 3.6e9) AS temp
          FROM fold, ends QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1)"""
FILE_FINAL = """
ends AS (SELECT CAST(max(commitdate) AS DATE) + 1 AS end_day FROM revisions),
final AS (SELECT k AS changedpath, i AS n_changes,
                 1.1 + (t - 1.1) * exp(-0.0025 * (epoch_us(CAST(end_day AS TIMESTAMP))
                   - epoch_us(date_trunc('minute', ts))) / 3.6e9) AS temp
          FROM fold, ends QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1)"""
DIR2 = "'/' || split_part(changedpath, '/', 2) || '/' || split_part(changedpath, '/', 3)"
DIR1 = "'/' || split_part(changedpath, '/', 2)"
DIR_OTHERS = f"""
sizes AS (SELECT {DIR2} AS directory, sum(linesadded - linesdeleted) AS loc FROM changes GROUP BY 1),
tot AS (SELECT sum(loc) AS total, count(*) FILTER (loc > 0) AS n FROM sizes),
kept AS (SELECT directory, loc FROM sizes, tot WHERE loc > 0 AND (n <= 10 OR loc > 0.005 * total)
         ORDER BY loc DESC, directory LIMIT 10),
listed AS (SELECT directory, loc FROM kept
           UNION ALL SELECT 'others', total - coalesce((SELECT sum(loc) FROM kept), 0) FROM tot WHERE n > 10)"""

ORACLES: dict[str, str] = {
    # Scope and filters
    "path_scope": _o("""SELECT changetype, count(*) AS n, CAST(sum(linesadded) AS BIGINT) AS lines
        FROM changes WHERE starts_with(changedpath, '/PROMO/') GROUP BY 1"""),
    "rev_range": _o("""SELECT msg, count(*) AS n, min(revno) AS lo, max(revno) AS hi FROM revisions
        WHERE revno BETWEEN 100 AND 5000 GROUP BY 1"""),
    "scope": _o("""SELECT revno, strftime(commitdate, '%Y-%m-%d %H:%M:%S.%f') AS commitdate, author FROM revisions
        WHERE revno >= 50 AND revno IN (SELECT revno FROM changes WHERE changedpath LIKE '/LARGE/%')"""),
    "recent_months": _o("""SELECT revno, strftime(commitdate, '%Y-%m-%d %H:%M:%S.%f') AS commitdate
        FROM revisions, (SELECT CAST(max(commitdate) AS DATE) + 1 AS e FROM revisions)
        WHERE commitdate >= date_trunc('month', e) - INTERVAL 6 MONTH + to_days(CAST(day(e) - 1 AS INTEGER))"""),
    "bugfix_filter": """SELECT doc_id AS revno, source AS author FROM documents
        WHERE text LIKE '%sh%' OR text LIKE '%ing%'""",
    "date_in_range": _e("""SELECT msg, count(*) AS n FROM revisions, (
          SELECT CAST(min(commitdate) AS DATE) - 1 AS lo, CAST(max(commitdate) AS DATE) + 1 AS hi FROM revisions)
        WHERE CAST(commitdate AS DATE) BETWEEN lo AND hi GROUP BY 1"""),
    "file_changes": _o("""SELECT changedpath, count(*) AS n FROM changes
        WHERE pathtype = 'F' AND changetype IN ('A', 'R') GROUP BY 1"""),
    "in_repo_url": _o("""SELECT changedpath, count(*) AS n FROM changes
        WHERE starts_with('http://host/repo' || changedpath, 'http://host/repo/SMALL/Brand1') GROUP BY 1"""),
    # Aggregates
    # The dashboard under a prefix and a range of revisions: ``scoped`` revisions, ``under`` all changes of the prefix.
    "report": _o(f"""SELECT 'churn' AS section, {DAY.format('CAST(commitdate AS DATE)')} AS name, CAST(sum(linesadded + linesdeleted) AS DOUBLE) AS value
        FROM revisions JOIN under USING (revno) GROUP BY 2
        UNION ALL SELECT 'daily_commits', {DAY.format('CAST(commitdate AS DATE)')}, count(*) FROM revisions GROUP BY 2
        UNION ALL SELECT 'weekday', ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][i + 1], count(revno)
          FROM range(7) t(i) LEFT JOIN scoped ON dayofweek(commitdate) = i GROUP BY i
        UNION ALL SELECT 'hour', CAST(i AS VARCHAR), count(revno) FROM range(24) t(i) LEFT JOIN scoped ON hour(commitdate) = i GROUP BY i
        UNION ALL SELECT 'active_authors', author, round(temp, 4) FROM (
          SELECT author, 1.1 + 10 * sum(x) - 1.1 * min(x) AS temp FROM (
            SELECT author, exp(-0.0025 * (epoch_us(CAST(end_day AS TIMESTAMP)) - epoch_us(commitdate)) / 3.6e9) AS x
            FROM scoped, (SELECT CAST(max(commitdate) AS DATE) + 1 AS end_day FROM revisions)) GROUP BY 1
          ORDER BY 2 DESC, 1 LIMIT 10)
        UNION ALL SELECT 'file_types', CASE WHEN ext = '' THEN '{{no ext}}' ELSE ext END, files FROM (
          SELECT regexp_extract(changedpath, '[^./][^/]*(\\.[^./]*)$', 1) AS ext, sum(CASE changetype WHEN 'A' THEN 1 ELSE -1 END) AS files
          FROM under WHERE changetype IN ('A', 'D') GROUP BY 1 ORDER BY 2 DESC, CASE WHEN ext = '' THEN '{{no ext}}' ELSE ext END LIMIT 20)""",
        "under AS (SELECT * FROM changes WHERE starts_with(changedpath, '/ECONOMY/'))",
        """scoped AS (SELECT * FROM revisions WHERE revno BETWEEN 100 AND 4000
             AND revno IN (SELECT revno FROM under WHERE revno BETWEEN 100 AND 4000))"""),
    "author_ranking": _o("SELECT author, count(*) AS commits FROM revisions GROUP BY 1"),
    "author_ranking_top": _e("""SELECT author, count(*) AS commits FROM revisions GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 10"""),
    "author_ranking_by_type": _e("""SELECT msg AS repo, author, count(*) AS commits FROM revisions GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY msg ORDER BY count(*) DESC, author) <= 3"""),
    "activity_by_weekday": _e("""SELECT i AS weekday,
          ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][i + 1] AS name,
          count(revno) AS commits
        FROM range(7) t(i) LEFT JOIN revisions ON dayofweek(commitdate) = i GROUP BY i"""),
    "activity_by_weekday_recent": _o("""SELECT i AS weekday,
          ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][i + 1] AS name, count(revno) AS commits
        FROM range(7) t(i) LEFT JOIN (
          SELECT revno, commitdate FROM revisions, (SELECT CAST(max(commitdate) AS DATE) + 1 AS e FROM revisions)
          WHERE commitdate >= date_trunc('month', e) - INTERVAL 3 MONTH + to_days(CAST(day(e) - 1 AS INTEGER))) r
        ON dayofweek(commitdate) = i GROUP BY i"""),
    "activity_by_hour": _e("""SELECT i AS hour, count(revno) AS commits
        FROM range(24) t(i) LEFT JOIN revisions ON hour(commitdate) = i GROUP BY i"""),
    "activity_by_hour_local": _e("""SELECT i AS hour, count(revno) AS commits
        FROM range(24) t(i) LEFT JOIN revisions ON hour(commitdate - INTERVAL 5 HOUR) = i GROUP BY i"""),
    "weekday_hour_pivot": _e("SELECT i AS weekday, ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][i + 1] AS name, "
        + ", ".join(f"count(revno) FILTER (hour(commitdate) = {h}) AS h{h}" for h in range(24))
        + " FROM range(7) t(i) LEFT JOIN revisions ON dayofweek(commitdate) = i GROUP BY i"),
    "file_types": _o("""SELECT CASE WHEN ext = '' THEN '{no ext}' ELSE ext END AS file_type,
          CAST(sum(CASE changetype WHEN 'A' THEN 1 ELSE -1 END) AS BIGINT) AS files
        FROM (SELECT changetype, regexp_extract(changedpath, '[^./][^/]*(\\.[^./]*)$', 1) AS ext
              FROM changes WHERE pathtype = 'F' AND changetype IN ('A', 'D')) GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 20"""),
    "author_activity": _o("""SELECT author, round(100.0 * a / nullif(a + c + d, 0), 4) AS added_pct,
          round(100.0 * c / nullif(a + c + d, 0), 4) AS changed_pct,
          round(100.0 * d / nullif(a + c + d, 0), 4) AS deleted_pct, commits
        FROM (SELECT author, sum(a) AS a, sum(c) AS c, sum(d) AS d, count(DISTINCT revno) AS commits
              FROM revisions JOIN counters USING (revno) JOIN changes USING (revno) GROUP BY 1)
        ORDER BY commits DESC, author LIMIT 10""",
        """counters AS (SELECT revno, count(*) FILTER (changetype = 'A') AS a,
             count(*) FILTER (changetype IN ('M', 'R')) AS c, count(*) FILTER (changetype = 'D') AS d
             FROM changes GROUP BY 1)"""),
    "dir_file_count": _o("""SELECT directory, CAST(files AS BIGINT) AS files FROM ranked WHERE rn <= 10
        UNION ALL SELECT 'others', CAST(sum(files) AS BIGINT) FROM ranked WHERE rn > 10 HAVING count(*) > 0""",
        f"""counts AS (SELECT {DIR2} AS directory, sum(CASE changetype WHEN 'A' THEN 1 ELSE -1 END) AS files
             FROM changes WHERE changetype IN ('A', 'D') GROUP BY 1),
        ranked AS (SELECT *, row_number() OVER (ORDER BY files DESC, directory) AS rn FROM counts)"""),
    "dir_loc": _o(f"""SELECT {DIR1} AS directory, CAST(sum(linesadded - linesdeleted) AS BIGINT) AS loc
        FROM changes GROUP BY 1 HAVING sum(linesadded - linesdeleted) > 0"""),
    "dir_loc_others": _o("SELECT directory, CAST(loc AS BIGINT) AS loc FROM listed", DIR_OTHERS),
    "dir_names": _o(f"SELECT DISTINCT {DIR2} AS directory FROM changes"),
    "churn_by_day": _o(f"""SELECT {DAY.format('CAST(commitdate AS DATE)')} AS day,
          CAST(sum(linesadded + linesdeleted) AS BIGINT) AS churn
        FROM revisions JOIN changes USING (revno) GROUP BY 1"""),
    "daily_commit_count": _o(f"""SELECT {DAY.format('CAST(commitdate AS DATE)')} AS day, count(*) AS commits
        FROM revisions GROUP BY 1"""),
    "author_commit_times": _e("""SELECT DISTINCT author, strftime(commitdate, '%Y-%m-%d %H:%M:%S.%f') AS commitdate,
          strftime(commitdate, '%Y-%m-%d') AS day, hour(commitdate) AS hour
        FROM revisions r JOIN (SELECT author AS a, min(commitdate) AS f FROM revisions WHERE hour(commitdate) <> 0
                               GROUP BY 1) ON a = author AND commitdate >= f"""),
    "basic_stats": _o("""SELECT min(revno) AS first_rev, max(revno) AS last_rev,
          strftime(arg_min(commitdate, revno), '%Y-%m-%d %H:%M:%S.%f') AS first_rev_date,
          strftime(arg_max(commitdate, revno), '%Y-%m-%d %H:%M:%S.%f') AS last_rev_date,
          count(*) AS num_revs, count(DISTINCT lower(author)) AS num_authors,
          (SELECT count(*) FILTER (changetype = 'A') - count(*) FILTER (changetype = 'D')
           FROM changes) AS num_files,
          (SELECT CAST(sum(linesadded - linesdeleted) AS BIGINT)
           FROM changes) AS loc
        FROM revisions"""),
    "author_cloud": _e("""SELECT author, commits, round(temp, 4) AS activity FROM final
        WHERE temp > 0 ORDER BY temp DESC, author LIMIT 50""", AUTHOR_FOLD),
    "active_authors": _e("""SELECT author, round(temp, 4) AS temperature FROM final
        ORDER BY temp DESC, author LIMIT 10""", AUTHOR_FOLD),
    "hot_files": _o("""SELECT changedpath, round(temp, 4) AS temperature, n_changes FROM final
        ORDER BY temp DESC, changedpath LIMIT 10""", FILE_FOLD, FILE_FINAL),
    "hot_files_events": _e("""SELECT changedpath, round(temp, 4) AS temperature, n_changes FROM final
        ORDER BY temp DESC, changedpath LIMIT 25""", FILE_FOLD, FILE_FINAL),
    "commit_gap_histogram": _e("""SELECT bin, label, count(gap) AS commits
        FROM (VALUES (0, '0-1 hr', 0.0, 1/24.0), (1, '1-4 hrs', 1/24.0, 4/24.0), (2, '4hrs-1 day', 4/24.0, 1.0),
              (3, '1-2 days', 1.0, 2.0), (4, '2-4 days', 2.0, 4.0), (5, '4-8 days', 4.0, 8.0),
              (6, '8-16 days', 8.0, 16.0)) b(bin, label, lo, hi)
        LEFT JOIN gaps ON gap >= lo AND gap < hi GROUP BY 1, 2""", TOP20,
        """gaps AS (SELECT (epoch_us(commitdate) - epoch_us(lag(commitdate) OVER
             (PARTITION BY author ORDER BY commitdate, revno))) / 8.64e10 AS gap
             FROM revisions JOIN top20 USING (author))"""),
    "commit_gap_stats": _e("""SELECT author, round(avg(coalesce(g1, 0)), 4) AS mean_days,
          round(coalesce(stddev_samp(g2), 0), 4) AS stddev FROM gaps GROUP BY 1""", TOP20,
        """gaps AS (SELECT author,
             (epoch_us(lead(commitdate) OVER (PARTITION BY author ORDER BY revno)) - epoch_us(commitdate)) / 8.64e10 AS g1,
             (epoch_us(commitdate) - epoch_us(lag(commitdate) OVER (PARTITION BY author ORDER BY commitdate, revno)))
               / 8.64e10 AS g2
             FROM revisions JOIN top20 USING (author))"""),
    "commit_gap_stats_recent": _o("""SELECT m.author, round(m.v, 4) AS mean_days, round(s.v, 4) AS stddev
        FROM (SELECT author, avg(CASE WHEN nxt >= since THEN (epoch_us(nxt) - epoch_us(commitdate)) / 8.64e10
                                      ELSE 0 END) AS v
              FROM ranked WHERE commitdate >= since GROUP BY 1) m
        JOIN (SELECT author, coalesce(stddev_samp(g), 0) AS v FROM (
                SELECT author, (epoch_us(commitdate) - epoch_us(lag(commitdate) OVER
                  (PARTITION BY author ORDER BY commitdate, revno))) / 8.64e10 AS g
                FROM ranked WHERE commitdate >= since) GROUP BY 1) s ON m.author = s.author""", TOP20,
        """ranked AS (SELECT author, revno, commitdate, since,
             lead(commitdate) OVER (PARTITION BY author ORDER BY revno) AS nxt
           FROM revisions JOIN top20 USING (author), (
             SELECT date_trunc('month', e) - INTERVAL 12 MONTH + to_days(CAST(day(e) - 1 AS INTEGER)) AS since
             FROM (SELECT CAST(max(commitdate) AS DATE) + 1 AS e FROM revisions)))"""),
    "commit_gap_band": _e("""SELECT author, round(m, 4) AS avg, round(m + 1.28 * s, 4) AS hi,
          round(greatest(0, m - 1.28 * s), 4) AS lo
        FROM (SELECT author, avg(coalesce(g1, 0)) AS m, coalesce(stddev_samp(g2), 0) AS s FROM gaps GROUP BY 1)""",
        TOP20,
        """gaps AS (SELECT author,
             (epoch_us(lead(commitdate) OVER (PARTITION BY author ORDER BY revno)) - epoch_us(commitdate)) / 8.64e10 AS g1,
             (epoch_us(commitdate) - epoch_us(lag(commitdate) OVER (PARTITION BY author ORDER BY commitdate, revno)))
               / 8.64e10 AS g2
             FROM revisions JOIN top20 USING (author))"""),
    "deltastddev": _e("""SELECT author, round(coalesce(stddev_samp(g), 0), 4) AS stddev FROM (
          SELECT author, (epoch_us(commitdate) - epoch_us(lag(commitdate) OVER
            (PARTITION BY author ORDER BY commitdate, revno))) / 8.64e10 AS g FROM revisions) GROUP BY 1"""),
    "path_change_counts": _o("SELECT changedpath, count(*) AS n_changes FROM changes GROUP BY 1"),
    "deleted_paths": _o("SELECT DISTINCT changedpath FROM changes WHERE changetype = 'D'"),
    "max_commit_date": _o("SELECT strftime(max(commitdate), '%Y-%m-%d') AS max_day FROM revisions"),
    "revision_for_date": _o("""SELECT
          (SELECT revno FROM revisions WHERE commitdate >= '1997-03-01' ORDER BY commitdate, revno LIMIT 1) AS first_rev,
          coalesce((SELECT revno FROM revisions WHERE commitdate BETWEEN '2000-06-15' AND '2000-06-16'
                    ORDER BY commitdate DESC, revno DESC LIMIT 1), (SELECT max(revno) FROM revisions)) AS last_rev"""),
    # Series
    "loc_trend": _o(f"SELECT {DAY.format('day')} AS day, v AS loc FROM stripped", NET_DAILY, RUNNING, FILLED),
    "author_loc_trend": _o(f"SELECT g AS author, {DAY.format('day')} AS day, v AS loc FROM stripped",
        """top10 AS (SELECT author FROM revisions GROUP BY 1 ORDER BY count(*) DESC, author LIMIT 10),
        daily AS (SELECT author AS g, CAST(commitdate AS DATE) AS day, sum(linesadded - linesdeleted) AS d
          FROM revisions JOIN changes USING (revno) JOIN top10 USING (author) GROUP BY 1, 2)""", RUNNING, FILLED),
    "author_loc_trend_all": _o(f"SELECT g AS author, {DAY.format('day')} AS day, v AS loc FROM stripped",
        """daily AS (SELECT author AS g, CAST(commitdate AS DATE) AS day, sum(linesadded - linesdeleted) AS d
          FROM revisions JOIN changes USING (revno) GROUP BY 1, 2)""", RUNNING, FILLED),
    "file_count_trend": _o(f"SELECT {DAY.format('day')} AS day, v AS files FROM stripped",
        """daily AS (SELECT '' AS g, CAST(commitdate AS DATE) AS day,
            sum(CASE changetype WHEN 'A' THEN 1 ELSE -1 END) AS d
          FROM revisions JOIN changes USING (revno) WHERE changetype IN ('A', 'D') GROUP BY 2)""", RUNNING, FILLED),
    "avg_loc_trend": _o(f"""SELECT {DAY.format('day')} AS day, round(v, 4) AS avg_loc FROM all_rows
          WHERE day >= (SELECT min(day) FROM all_rows WHERE v <> 0)""",
        """sums AS (SELECT CAST(commitdate AS DATE) AS day, sum(linesadded - linesdeleted) AS l,
            count(*) FILTER (changetype = 'A') - count(*) FILTER (changetype = 'D') AS f
          FROM revisions JOIN changes USING (revno) GROUP BY 1),
        run AS (SELECT day, sum(l) OVER (ORDER BY day) AS l, sum(f) OVER (ORDER BY day) AS f FROM sums),
        vals AS (SELECT day, CASE WHEN f > 0 THEN CAST(l AS DOUBLE) / f ELSE 0 END AS v FROM run),
        all_rows AS (SELECT day, v FROM vals UNION ALL
          SELECT CAST(e AS DATE) + 1, (SELECT v FROM vals ORDER BY day DESC LIMIT 1)
          FROM (SELECT max(commitdate) AS e FROM revisions)
          WHERE (SELECT max(day) FROM vals) < CAST(e AS DATE) + 1)"""),
    "dir_loc_trend": _o(f"SELECT g AS directory, {DAY.format('day')} AS day, v AS loc FROM stripped",
        f"""daily AS (SELECT {DIR2} AS g, CAST(commitdate AS DATE) AS day,
            sum(CASE changetype WHEN 'M' THEN 0 ELSE linesadded END)
              - sum(linesdeleted + CASE changetype WHEN 'M' THEN 40 ELSE 0 END) AS d
          FROM revisions JOIN changes USING (revno) GROUP BY 1, 2),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY day) AS i FROM daily),
        fold(g, i, day, v) AS (
          SELECT g, i, day, greatest(0, CAST(d AS BIGINT)) FROM numbered WHERE i = 1
          UNION ALL SELECT n.g, n.i, n.day, greatest(0, f.v + CAST(n.d AS BIGINT))
          FROM fold f JOIN numbered n ON n.g = f.g AND n.i = f.i + 1),
        trend AS (SELECT g, day, v FROM fold)""", FILLED),
    "dir_loc_trend_listed": _o(f"SELECT g AS directory, {DAY.format('day')} AS day, v AS loc FROM stripped",
        DIR_OTHERS,
        """daily AS (SELECT directory AS g, CAST(commitdate AS DATE) AS day, sum(linesadded - linesdeleted) AS d
          FROM listed JOIN changes ON starts_with(changedpath, directory) JOIN revisions USING (revno) GROUP BY 1, 2),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY day) AS i FROM daily),
        fold(g, i, day, v) AS (
          SELECT g, i, day, greatest(0, CAST(d AS BIGINT)) FROM numbered WHERE i = 1
          UNION ALL SELECT n.g, n.i, n.day, greatest(0, f.v + CAST(n.d AS BIGINT))
          FROM fold f JOIN numbered n ON n.g = f.g AND n.i = f.i + 1),
        trend AS (SELECT g, day, v FROM fold)""", FILLED),
    "waste_effort": _o(f"""SELECT {DAY.format('day')} AS day, CAST(a AS BIGINT) AS lines_added,
          CAST(d AS BIGINT) AS lines_deleted, round(CASE WHEN a > 0 THEN CAST(d AS DOUBLE) / a ELSE 0 END, 4) AS waste_ratio
        FROM (SELECT day, sum(a) OVER (ORDER BY day) AS a, sum(d) OVER (ORDER BY day) AS d FROM (
          SELECT CAST(commitdate AS DATE) AS day, sum(linesadded) AS a, sum(linesdeleted) AS d
          FROM revisions JOIN changes USING (revno) GROUP BY 1))"""),
    "bugfix_trend": _o(f"""SELECT {DAY.format('day')} AS day, n AS file_changes,
          CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total
        FROM (SELECT CAST(commitdate AS DATE) AS day, count(*) AS n FROM revisions JOIN changes USING (revno)
              WHERE msg LIKE '%URGENT%' OR msg LIKE '%HIGH%' GROUP BY 1)"""),
    "author_temperature": _e("""SELECT k AS author, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS commitdate,
          round(max(t), 4) AS temperature FROM fold GROUP BY k, ts""", AUTHOR_FOLD),
    "file_temperature": _o("""SELECT k AS changedpath, revno, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS commitdate,
          round(max(t), 4) AS temperature FROM fold GROUP BY k, revno, ts""", FILE_FOLD),
    "revision_temperature": _o("""SELECT r.revno, strftime(commitdate, '%Y-%m-%d %H:%M:%S.%f') AS commitdate,
          round(coalesce(max(t), 0), 4) AS temperature
        FROM revisions r LEFT JOIN fold f ON f.revno = r.revno GROUP BY 1, 2""", FILE_FOLD),
    "revision_activity_index": _e("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS commitdate,
          strftime(ts, '%Y-%m-%d') AS day, round(r, 4) AS activity FROM walk WHERE r > 0""", FILE_FOLD,
        """raw AS (SELECT ts, max(t) AS t, row_number() OVER (ORDER BY ts) AS i FROM fold GROUP BY ts),
        walk(i, ts, r) AS (
          SELECT i, ts, t FROM raw WHERE i = 1
          UNION ALL SELECT n.i, n.ts,
            greatest(n.t, 1.1 + (w.r - 1.1) * exp(-0.0025 * 24 * (CAST(n.ts AS DATE) - CAST(w.ts AS DATE))))
          FROM walk w JOIN raw n ON n.i = w.i + 1)"""),
    "revision_gaps": _e("""SELECT revno, CASE WHEN author IN (SELECT author FROM top10) THEN author ELSE 'others' END AS author,
          round(h, 4) AS hours
        FROM (SELECT revno, author, (epoch_us(commitdate) - epoch_us(lag(commitdate) OVER (ORDER BY revno))) / 3.6e9 AS h
              FROM revisions) WHERE h IS NOT NULL""",
        "top10 AS (SELECT author FROM revisions GROUP BY 1 ORDER BY count(*) DESC, author LIMIT 10)"),
    "gap_fill": _o(f"SELECT g AS author, {DAY.format('day')} AS day, v AS commits FROM filled",
        "trend AS (SELECT author AS g, CAST(commitdate AS DATE) AS day, count(*) AS v FROM revisions GROUP BY 1, 2)",
        FILLED),
    "strip_leading_zeros": _o(f"""SELECT d.author, {DAY.format('d.day')} AS day, urgent FROM d
          JOIN (SELECT author, min(day) AS f FROM d WHERE urgent > 0 GROUP BY 1) s ON s.author = d.author AND d.day >= f""",
        """d AS (SELECT author, CAST(commitdate AS DATE) AS day, count(*) FILTER (msg = '1-URGENT') AS urgent
             FROM revisions GROUP BY 1, 2)"""),
    "rank_desc": _e("""SELECT author, revno, row_number() OVER (PARTITION BY author ORDER BY revno DESC) AS rank
        FROM revisions"""),
    "top_k_with_others": _o("""SELECT msg, author, commits FROM r WHERE rn <= 5
        UNION ALL SELECT msg, 'others', CAST(sum(commits) AS BIGINT) FROM r WHERE rn > 5 GROUP BY 1""",
        """r AS (SELECT msg, author, count(*) AS commits,
             row_number() OVER (PARTITION BY msg ORDER BY count(*) DESC, author) AS rn FROM revisions GROUP BY 1, 2)"""),
}

# The words left out of the counts, as one pattern.
STOP = (
    "\\d+|an|the|me|my|we|you|he|she|it|are|is|am|will|shall|should|would|had|have|has|was|were|be|been|"
    "this|that|there|who|when|how|where|which|already|after|by|on|or|so|also|got|get|do|don''t|from|all|but|"
    "yet|to|in|out|of|for|if|yes|no|not|may|can|could|at|as|with|without"
)


def _words(min_freq: int, tail: str) -> str:
    return f"""
raw AS (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents),
counts AS (SELECT lower(w) AS word, count(*) AS freq FROM raw
           WHERE length(w) >= 2 AND NOT regexp_matches(w, '(?i)^(?:{STOP}){tail}') GROUP BY 1 HAVING count(*) >= {min_freq}),
stems AS (SELECT word, p, CASE WHEN ends_with(word, x) THEN left(word, length(word) - length(x)) END AS stem
          FROM counts, (VALUES (0, 'ed'), (1, 'ing'), (2, 's'), (3, 'es')) v(p, x)),
parents AS (SELECT s.word, arg_min(s.stem, s.p) AS parent FROM stems s JOIN counts c ON c.word = s.stem GROUP BY 1),
chain(word, root) AS (SELECT word, word FROM counts
                      UNION ALL SELECT c.word, p.parent FROM chain c JOIN parents p ON p.word = c.root),
merged AS (SELECT root AS word, CAST(sum(freq) AS BIGINT) AS freq
           FROM chain JOIN counts USING (word) WHERE root NOT IN (SELECT word FROM parents) GROUP BY 1)"""


def _level(points: list[tuple[float, float]]) -> str:
    arms = "".join(
        f" WHEN h <= {x1} THEN {y0} + (h - {x0}) / ({x1} - {x0}) * ({y1} - {y0})"
        for (x0, y0), (x1, y1) in zip(points[:-1], points[1:])
    )
    return f"CAST(floor(255 * (CASE{arms} END) + 0.5) AS INTEGER)"


RELEASES = """
files AS (SELECT revno * 10 AS revno, changedpath, changetype, linesadded, linesdeleted FROM changes),
sup AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_acctbal AS bal, s_suppkey * 1500 + 605 AS at_rev,
               s_suppkey * 1500 + 600 - s_nationkey * 10 AS cr,
               '/' || p_type || '/' || replace(p_brand, '#', '') || '/' AS brand
        FROM supplier JOIN part ON p_partkey = s_suppkey),
state AS (SELECT k, bal, at_rev, cr, brand, changedpath,
                 max(revno) FILTER (changetype IN ('A', 'R')) AS a, max(revno) FILTER (changetype = 'D') AS d,
                 sum(linesadded - linesdeleted) AS net
          FROM sup JOIN files ON starts_with(changedpath, brand) AND revno <= cr GROUP BY ALL),
tagged AS (SELECT k, bal, at_rev, at_rev AS revno, '/tags/' || k || '/' || substr(changedpath, length(brand) + 1) AS changedpath,
                  changedpath AS copyfrompath, cr AS copyfromrev, CAST(greatest(net, 0) AS BIGINT) AS lines
           FROM state WHERE a >= coalesce(d, -1)),
again AS (SELECT at_rev + CASE WHEN bal < 0 THEN 202 ELSE 303 END AS revno,
                 CASE WHEN bal < 0 THEN '/restored/' ELSE '/releases/' END || substr(changedpath, 7) AS changedpath,
                 changedpath AS copyfrompath, at_rev + CASE WHEN bal < 0 THEN 50 ELSE 250 END AS copyfromrev, lines
          FROM tagged WHERE bal < 0 OR bal > 5000)"""

DICTIONARY = """
words AS (SELECT path, row_number() OVER (ORDER BY substr(md5(path), 1, 3), path) AS path_id
          FROM (SELECT DISTINCT changedpath AS path FROM changes WHERE changetype = 'A')),
encoded AS (SELECT revno, path_id AS changedpathid, path_id - 1 AS copyfrompathid, linesadded
            FROM changes JOIN words ON path = changedpath)"""


def _pairs(path: str = "changedpath") -> str:
    return f"""
items AS (SELECT revno, {path} AS p, count(*) AS n FROM changes GROUP BY 1, 2),
pairs AS (SELECT a.p AS src, b.p AS dst, a.revno, a.n * b.n AS n FROM items a JOIN items b ON a.revno = b.revno AND a.p < b.p)"""


COCHANGE = _pairs() + """,
links AS (SELECT src, dst, CAST(sum(n) AS DOUBLE) AS weight FROM pairs GROUP BY 1, 2)"""
DECAYED = _pairs() + """,
links AS (SELECT src, dst, sum(n * 10 * exp(-0.005 * (m - CAST(commitdate AS DATE)))) AS weight
          FROM pairs JOIN revisions USING (revno), (
            SELECT max(CAST(commitdate AS DATE)) AS m FROM revisions WHERE revno IN (SELECT revno FROM changes))
          GROUP BY 1, 2)"""
ALL_LINKS = COCHANGE + ", e AS (SELECT src, dst, weight FROM links)"
AUTHOR_NETWORK = """
e AS (SELECT src, dst, 1 / ln(w) AS weight FROM (
  SELECT author AS src, changedpath AS dst, count(*) AS w FROM changes JOIN revisions USING (revno) GROUP BY 1, 2)
  WHERE w >= 1.1)"""


def _core(k: int) -> str:
    return f"""
peel(it, src, dst, weight) AS (
  SELECT 0, src, dst, weight FROM e
  UNION ALL
  SELECT it + 1, src, dst, weight FROM (
    SELECT *, (SELECT count(*) FROM peel) AS total, count(*) OVER () AS kept FROM peel
    WHERE src IN (SELECT n FROM (SELECT src AS n FROM peel UNION ALL SELECT dst FROM peel) GROUP BY n HAVING count(*) >= {k})
      AND dst IN (SELECT n FROM (SELECT src AS n FROM peel UNION ALL SELECT dst FROM peel) GROUP BY n HAVING count(*) >= {k}))
  WHERE kept < total),
last AS (SELECT src, dst, weight FROM peel WHERE it = (SELECT max(it) FROM peel)),
core AS (SELECT * FROM last
         WHERE src IN (SELECT n FROM (SELECT src AS n FROM last UNION ALL SELECT dst FROM last) GROUP BY n HAVING count(*) >= {k})
           AND dst IN (SELECT n FROM (SELECT src AS n FROM last UNION ALL SELECT dst FROM last) GROUP BY n HAVING count(*) >= {k}))"""


HEAVY_LINKS = DECAYED + ", e AS (SELECT src, dst, weight FROM links WHERE weight >= 1)"


def _network(body: str, *ctes: str) -> str:
    """Over the file network, its links being called ``e``."""
    inner = _o("SELECT src, dst, weight FROM core", HEAVY_LINKS, _core(5))
    return "WITH RECURSIVE " + ",".join((f"e AS ({inner})", *ctes)) + body


COMPONENTS = """
g AS (SELECT src AS u, dst AS v FROM e UNION ALL SELECT dst, src FROM e),
closure(node, r) AS (SELECT DISTINCT u, u FROM g UNION SELECT c.node, g.v FROM closure c JOIN g ON g.u = c.r),
comp AS (SELECT node, min(r) AS component FROM closure GROUP BY 1)"""
# Each pair is kept once, at its first (smallest) distance.
DISTANCES = """
g AS (SELECT src AS u, dst AS v FROM e UNION ALL SELECT dst, src FROM e),
far(s, v, d) USING KEY (s, v) AS (
  SELECT DISTINCT u, u, 0 FROM g UNION
  SELECT w.s, g.v, min(w.d + 1) FROM far w JOIN g ON g.u = w.v LEFT JOIN recurring.far x ON x.s = w.s AND x.v = g.v
  WHERE x.s IS NULL GROUP BY 1, 2),
close AS (SELECT s AS node, CASE WHEN sum(d) > 0 THEN (count(*) - 1) / CAST(sum(d) AS DOUBLE) * (count(*) - 1)
            / ((SELECT count(DISTINCT u) FROM g) - 1) ELSE 0 END AS closeness, max(d) AS ecc, min(v) AS component, count(*) AS size,
            (count(*) - 1) / CAST(sum(d) AS DOUBLE) AS inner_closeness FROM far GROUP BY 1),
dist AS (SELECT s, v, d FROM far)"""
# For a network of few steps across and many pairs: the nodes within h steps of each as bits.
NEAR_DISTANCES = """
g AS (SELECT src AS u, dst AS v FROM e UNION ALL SELECT dst, src FROM e),
names AS (SELECT u AS node, row_number() OVER (ORDER BY u) - 1 AS id, count(*) OVER () AS n FROM (SELECT DISTINCT u FROM g)),
near(h, node, bits) AS (
  SELECT 0, node, set_bit(CAST(repeat('0', n) AS BIT), CAST(id AS INTEGER), 1) FROM names
  UNION ALL SELECT h + 1, node, bit_or(bits) FROM (
    SELECT h, node, bits FROM near UNION ALL SELECT near.h, g.v, bits FROM near JOIN g ON g.u = near.node)
  WHERE h < 16 GROUP BY h, node),
steps AS (SELECT node, h, bits, bit_count(bits) - coalesce(lag(bit_count(bits)) OVER (PARTITION BY node ORDER BY h), 0) AS gain FROM near),
sums AS (SELECT node, sum(gain) AS size, sum(h * gain) AS d, max(h) FILTER (gain > 0) AS ecc,
                bit_position('1'::BIT, arg_max(bits, h)) - 1 AS least FROM steps GROUP BY 1),
close AS (SELECT sums.node, CASE WHEN d > 0 THEN (size - 1) / CAST(d AS DOUBLE) * (size - 1) / (n - 1) ELSE 0 END AS closeness,
                 ecc, names.node AS component, size, (size - 1) / CAST(d AS DOUBLE) AS inner_closeness
          FROM sums JOIN names ON names.id = least)"""
LENGTHS = """
lg AS (SELECT src AS u, dst AS v, weight AS len FROM e UNION ALL SELECT dst, src, weight FROM e)"""
RELAX = """
relax(it, s, v, d) AS (
  SELECT DISTINCT 0, u, u, CAST(0 AS DOUBLE) FROM lg
  UNION ALL SELECT it + 1, s, v, min(d) FROM (
    SELECT it, s, v, d FROM relax UNION ALL SELECT it, s, lg.v, d + len FROM relax JOIN lg ON lg.u = relax.v)
  WHERE it < 60 GROUP BY it, s, v)"""
PATHS = """
sp(s, v, d) AS (SELECT DISTINCT u, u, 0 FROM g UNION ALL
  SELECT sp.s, g.v, sp.d + 1 FROM sp JOIN g ON g.u = sp.v JOIN dist ON dist.s = sp.s AND dist.v = g.v AND dist.d = sp.d + 1),
sigma AS (SELECT s, v, any_value(d) AS d, CAST(count(*) AS DOUBLE) AS c FROM sp GROUP BY 1, 2),
nn AS (SELECT count(DISTINCT u) AS n FROM g),
on_path AS MATERIALIZED (
  SELECT x.s, x.v AS u, y.v AS t, x.c, x.c * y.c / z.c AS share, z.c AS paths, y.d AS rest
  FROM sigma x JOIN sigma y ON y.s = x.v JOIN sigma z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d),
nb AS (SELECT node, coalesce(t, 0) / ((n - 1) * (n - 2)) AS b FROM (SELECT DISTINCT u AS node FROM g) CROSS JOIN nn LEFT JOIN (
  SELECT u, sum(share) AS t FROM on_path WHERE s <> u AND t <> u GROUP BY 1) ON u = node),
eb AS (SELECT least(g.u, g.v) AS src, greatest(g.u, g.v) AS dst, sum(p.c * y.c / p.paths) AS total
       FROM on_path p JOIN g ON g.u = p.u JOIN sigma y ON y.s = g.v AND y.v = p.t AND y.d = p.rest - 1 GROUP BY 1, 2)"""
NATIONS = """
revisions AS (
  SELECT o_orderkey AS revno, o_orderdate AS commitdate, n_name AS author, o_orderpriority AS msg
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""
_CHANGES_ONLY = ORDERS[ORDERS.index("changes AS"):]


def _n(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join((NATIONS, _CHANGES_ONLY, *ctes)) + body


COAUTHOR = """
touch AS (SELECT author, changedpath, revno, linesadded FROM changes JOIN revisions USING (revno) WHERE linesadded > 0),
firsts AS (SELECT author, changedpath, min(revno) AS f FROM touch GROUP BY 1, 2),
co AS (SELECT t.author AS src, x.author AS dst, CAST(sum(t.linesadded) AS DOUBLE) AS weight
       FROM touch t JOIN firsts x ON x.changedpath = t.changedpath AND x.f < t.revno AND x.author <> t.author
       GROUP BY 1, 2 HAVING sum(t.linesadded) > 1)"""
NODES = """
nodes AS (SELECT author AS label, row_number() OVER (ORDER BY min(revno)) - 1 AS id FROM revisions GROUP BY 1)"""
FIRST_LINKS = """
links AS (SELECT author, changedpath, min(CAST(commitdate AS DATE)) AS day FROM changes JOIN revisions USING (revno) GROUP BY 1, 2)"""


NODES_ON = """
born AS (SELECT min(day) AS day FROM links GROUP BY author UNION ALL SELECT min(day) FROM links GROUP BY changedpath),
nodes_on AS (SELECT day, (SELECT count(*) FROM born b WHERE b.day <= x.day) AS nodes FROM (
     SELECT DISTINCT CAST(commitdate AS DATE) AS day FROM revisions WHERE revno IN (SELECT revno FROM changes)) x)"""
# The earliest day t on which v is within h hops of the author s, where one more hop makes it earlier; and what that
# changes in the reached nodes (r), their distances (d) and the neighbours of each day.
HOPS_BY_DAY = """
g AS (SELECT 'a:' || author AS u, 'f:' || changedpath AS v, day FROM links
      UNION ALL SELECT 'f:' || changedpath, 'a:' || author, day FROM links),
hop(s, v, h, t) USING KEY (s, v, h) AS (
  SELECT u, u, 0, min(day) FROM g WHERE u LIKE 'a:%' GROUP BY u
  UNION
  SELECT n.s, n.v, n.h, n.t FROM (
    SELECT w.s, g.v, w.h + 1 AS h, min(greatest(w.t, g.day)) AS t FROM hop w JOIN g ON g.u = w.v GROUP BY 1, 2, 3) n
  LEFT JOIN (SELECT s, v, min(t) AS t FROM recurring.hop GROUP BY 1, 2) x ON x.s = n.s AND x.v = n.v
  WHERE x.t IS NULL OR n.t < x.t),
changed AS (SELECT s, day, sum(r) AS r, sum(d) AS d, sum(near) AS near FROM (
  SELECT s, t AS day, 1 AS r, h AS d, CAST(h = 1 AS INTEGER) AS near FROM hop
  UNION ALL SELECT s, until, -1, -h, 0 FROM (SELECT *, lag(t) OVER (PARTITION BY s, v ORDER BY h) AS until FROM hop) WHERE until IS NOT NULL)
  GROUP BY 1, 2)"""


ORACLES.update({
    # Text
    "word_frequency": "WITH RECURSIVE " + _words(3, "") + " SELECT word, freq FROM merged",
    "word_frequency_exact": "WITH RECURSIVE " + _words(10, "$") + " SELECT word, freq FROM merged",
    "tag_cloud": "WITH RECURSIVE " + _words(5, "") + " SELECT word, freq FROM merged ORDER BY freq DESC, word LIMIT 50",
    "cloud_style": _e(f"""SELECT author, commits, round(temp, 4) AS activity,
          CAST(floor(10 + (ln(commits) - base) * CASE WHEN hi = base THEN 1 ELSE 20 / (hi - base) END + 0.5) AS BIGINT) AS font_size,
          round(h0, 4) AS score_norm,
          printf('#%02X%02X%02X', {_level([(0.0, 0.0), (0.35, 0.0), (0.66, 1.0), (0.89, 1.0), (1.0, 0.5)])},
            {_level([(0.0, 0.0), (0.125, 0.0), (0.375, 1.0), (0.64, 1.0), (0.91, 0.0), (1.0, 0.0)])},
            {_level([(0.0, 0.5), (0.11, 1.0), (0.34, 1.0), (0.65, 0.0), (1.0, 0.0)])}) AS color
        FROM (SELECT *, ln(c1) AS hi, ln(c0) - (ln(c1) - ln(c0)) / 20 AS base, least(greatest(h0, 0.0000001), 1.0) AS h FROM (
          SELECT *, CASE WHEN temp - s0 > 1 THEN ln(temp - s0) / ln(s1 - s0) ELSE 0 END AS h0 FROM shown, (
            SELECT min(commits) AS c0, max(commits) AS c1, min(temp) AS s0, max(temp) AS s1 FROM shown)))""",
        AUTHOR_FOLD, "shown AS (SELECT * FROM final WHERE temp > 0 ORDER BY temp DESC, author LIMIT 50)"),
    # Log preparation
    "normalize_paths": """SELECT page_id AS revno, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+:', ''),
          '[?#].*$', ''), '/+', '/', 'g') AS path FROM pages""",
    "path_functions": _o("""SELECT DISTINCT changedpath, regexp_extract(changedpath, '(\\.[a-z]+)$', 1) AS file_type,
          '/' || split_part(changedpath, '/', 2) AS dir1,
          regexp_extract(changedpath, '^(.*)/[^/]*$', 1) AS dir3,
          regexp_extract(changedpath, '^(.*)/[^/]*$', 1) AS parent,
          split_part(changedpath, '/', 4) AS base,
          CASE WHEN starts_with(changedpath, '/PROMO') THEN substr(changedpath, 7) ELSE changedpath END AS relative,
          changedpath LIKE '%.js' AS is_binary
        FROM p""", """p AS (SELECT '/' || p_type || '/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || '_'
             || CAST(p_partkey AS VARCHAR)
             || CASE p_size % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.html' WHEN 2 THEN '.js' ELSE '' END AS changedpath FROM part)"""),
    "sql_functions": _o(f"""SELECT regexp_extract(changedpath, '(\\.[a-z]+)$', 1) AS ext, {DIR1} AS dir,
          round(sum(1.1 + 8.9 * exp(-0.0025 * (epoch_us(TIMESTAMP '2001-09-01') - epoch_us(commitdate)) / 3.6e9)), 4) AS heat
        FROM revisions JOIN changes USING (revno) GROUP BY 1, 2"""),
    "inherit_copyfrom": _o(f"""SELECT c.revno, changedpath, changetype,
          CASE WHEN changetype = 'A' THEN NULL WHEN b.revno IS NOT NULL THEN '/old' || changedpath
               WHEN t.revno IS NOT NULL THEN '/base' || changedpath END AS copyfrompath,
          CASE WHEN changetype = 'A' THEN NULL WHEN b.revno IS NOT NULL THEN c.revno - 2
               WHEN t.revno IS NOT NULL THEN c.revno - 1 END AS copyfromrev, count(*) AS n
        FROM changes c
        LEFT JOIN (SELECT DISTINCT revno, {DIR2} AS dir FROM changes WHERE changetype = 'A') b
          ON b.revno = c.revno AND b.dir = {DIR2}
        LEFT JOIN (SELECT DISTINCT revno, {DIR1} AS dir FROM changes WHERE changetype = 'D') t
          ON t.revno = c.revno AND t.dir = {DIR1}
        GROUP BY ALL"""),
    "copied_and_deleted_dirs": """SELECT s_suppkey * 1500 + 605 AS revno, '/tags/' || CAST(s_suppkey AS VARCHAR) || '/' AS changedpath,
          'copy' AS what FROM supplier JOIN part ON p_partkey = s_suppkey
        UNION ALL SELECT s_suppkey * 1500 + 706, '/tags/' || CAST(s_suppkey AS VARCHAR) || '/', 'delete'
          FROM supplier JOIN part ON p_partkey = s_suppkey WHERE s_acctbal < 0
        UNION ALL SELECT s_suppkey * 1500 + 807, '/restored/' || CAST(s_suppkey AS VARCHAR) || '/', 'copy'
          FROM supplier JOIN part ON p_partkey = s_suppkey WHERE s_acctbal < 0
        UNION ALL SELECT s_suppkey * 1500 + 908, '/releases/' || CAST(s_suppkey AS VARCHAR) || '/', 'copy'
          FROM supplier JOIN part ON p_partkey = s_suppkey WHERE s_acctbal > 5000""",
    "revision_file_counts": _o("""SELECT revno, count(*) FILTER (changetype = 'A') AS added_files,
          count(*) FILTER (changetype IN ('M', 'R')) AS changed_files,
          count(*) FILTER (changetype = 'D') AS deleted_files FROM changes GROUP BY 1"""),
    "diff_line_counts": _o("""SELECT changedpath, count(*) AS n, CAST(sum(linesadded) AS BIGINT) AS added,
          CAST(sum(linesdeleted) AS BIGINT) AS deleted FROM d GROUP BY 1
        UNION ALL SELECT '/props/' || changetype, count(*), 0, 0 FROM d GROUP BY 1""",
        "d AS (SELECT DISTINCT revno, changedpath, changetype, linesadded, linesdeleted FROM changes)"),
    "text_line_counts": """SELECT doc_id, length(text) - length(replace(text, chr(10), ''))
          + CASE WHEN length(text) > 0 AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS lines FROM documents""",
    "resolve_line_counts": _o("""SELECT changedpath, changetype, 'Y' AS lc_updated,
          CAST(sum(CASE changetype WHEN 'A' THEN lines WHEN 'R' THEN coalesce(fa, lines) WHEN 'M' THEN fa ELSE 0 END) AS BIGINT) AS added,
          CAST(sum(CASE changetype WHEN 'D' THEN before WHEN 'A' THEN 0 ELSE coalesce(fd, 0) END) AS BIGINT) AS deleted
        FROM changes c
        LEFT JOIN (SELECT revno AS r1, changedpath AS p1, max(lines) AS lines FROM contents GROUP BY 1, 2)
          ON r1 = revno AND p1 = changedpath
        LEFT JOIN (SELECT revno AS r2, changedpath AS p2, max(lines) AS before FROM contents GROUP BY 1, 2)
          ON r2 = revno - 1 AND p2 = changedpath
        LEFT JOIN (SELECT revno AS r3, changedpath AS p3, max(linesadded) AS fa, max(linesdeleted) AS fd FROM changes
                   WHERE changetype = 'M' OR (changetype = 'R' AND linesdeleted > 4) GROUP BY 1, 2)
          ON r3 = revno AND p3 = changedpath
        GROUP BY 1, 2""",
        """contents AS (SELECT revno, changedpath, linesadded + 1 AS lines FROM changes WHERE changetype IN ('A', 'R')
             UNION ALL SELECT revno - 1, changedpath, linesadded + 2 FROM changes WHERE changetype = 'D')"""),
    "encode_paths": _o("""SELECT path_id, path FROM words UNION ALL
        SELECT (SELECT max(path_id) FROM words) + row_number() OVER (ORDER BY substr(md5(path), 1, 3), path), path
        FROM (SELECT DISTINCT changedpath AS path FROM changes WHERE changedpath NOT IN (SELECT path FROM words))""", DICTIONARY),
    "change_view": _o("""SELECT a.path AS changedpath, b.path AS copyfrompath, count(*) AS n, CAST(sum(linesadded) AS BIGINT) AS lines
        FROM encoded LEFT JOIN words a ON a.path_id = changedpathid LEFT JOIN words b ON b.path_id = copyfrompathid
        GROUP BY 1, 2""", DICTIONARY),
    "repair_path_dictionary": _o("""SELECT changedpathid, path AS changedpath, count(*) AS n, CAST(sum(linesadded) AS BIGINT) AS lines
        FROM encoded JOIN words ON path_id = changedpathid GROUP BY 1, 2""", DICTIONARY),
    "live_files": _o("""SELECT changedpath, max(revno) FILTER (changetype IN ('A', 'R')) AS addrevno FROM changes
        WHERE revno <= 9000 AND changedpath LIKE '/STANDARD/%' GROUP BY 1
        HAVING max(revno) FILTER (changetype IN ('A', 'R')) >= coalesce(max(revno) FILTER (changetype = 'D'), -1)"""),
    "expand_dir_copies": _o("""SELECT revno, changedpath, 'A' AS changetype, copyfrompath, copyfromrev, lines AS linesadded,
          0 AS linesdeleted FROM tagged
        UNION ALL SELECT revno, changedpath, 'A', copyfrompath, copyfromrev, lines, 0 FROM again""", RELEASES),
    "expand_dir_deletes": _o("""SELECT at_rev + 101 AS revno, changedpath, 0 AS linesadded, lines AS linesdeleted
        FROM tagged WHERE bal < 0""", RELEASES),
    "update_file_counters": _o("""SELECT revno,
          count(changetype) FILTER (changetype = 'A') + count(changetype) FILTER (linesadded > 30 AND changetype <> 'A') AS added_files,
          count(changetype) FILTER (changetype IN ('M', 'R')) AS changed_files,
          count(changetype) FILTER (changetype = 'D') + count(changetype) FILTER (linesadded > 30 AND changetype = 'A') AS deleted_files
        FROM revisions LEFT JOIN changes USING (revno) GROUP BY 1"""),
    "overlay_line_counts": _o("""SELECT c.changedpath, 'Y' AS lc_updated, CAST(sum(coalesce(a, linesadded)) AS BIGINT) AS added,
          CAST(sum(CASE WHEN a IS NULL THEN linesdeleted ELSE 1 END) AS BIGINT) AS deleted
        FROM changes c LEFT JOIN (SELECT revno, changedpath, max(linesadded * 2) AS a FROM changes WHERE changetype = 'R'
                                  GROUP BY 1, 2) u USING (revno, changedpath) GROUP BY 1"""),
    "append_new": _e("""SELECT revno, author FROM revisions
        WHERE revno > (SELECT max(revno) FROM revisions WHERE commitdate < '2024-01-16')"""),
    "stream_new": _e(f"""SELECT {DAY.format('CAST(commitdate AS DATE)')} AS day, count(*) AS commits FROM revisions GROUP BY 1"""),
    "stream_daily_counts": _e(f"""SELECT {DAY.format('CAST(commitdate AS DATE)')} AS day, count(*) AS commits FROM revisions GROUP BY 1"""),
    "stream_author_scores": _e("""SELECT author, round(temp, 4) AS temperature, n AS commits FROM final
        JOIN (SELECT author, count(*) AS n FROM revisions GROUP BY 1) USING (author)""", AUTHOR_FOLD),
    "epoch_to_timestamp": _e("SELECT revno, strftime(commitdate, '%Y-%m-%d %H:%M:%S') AS moment FROM revisions"),
    "read_changes_xml": _o("SELECT 'orders' AS repo_id, revno, changedpath, changetype, 'F' AS pathtype FROM changes"),
    "read_changes_nested": _o("SELECT revno, changedpath, changetype, linesadded, linesdeleted FROM changes"),
    "merge_scores": _e("SELECT author, round(temp, 4) AS temperature FROM final", AUTHOR_FOLD),
    # Edges and graphs
    "author_file_edges": _o("""SELECT author AS src, changedpath AS dst, CAST(count(*) AS DOUBLE) AS weight
        FROM changes JOIN revisions USING (revno) GROUP BY 1, 2"""),
    "rev_file_edges": _o("SELECT DISTINCT CAST(revno AS VARCHAR) AS src, changedpath AS dst, CAST(2 AS DOUBLE) AS weight FROM changes"),
    "cochange_edges": _o("SELECT * FROM links", COCHANGE),
    "cochange_edges_blocks": _o("SELECT * FROM links", COCHANGE),
    "cochange_edges_decayed": _o("SELECT src, dst, round(weight, 4) AS weight FROM links", DECAYED),
    "author_network": _o("""SELECT src, dst, round(1 / ln(w), 4) AS weight FROM (
          SELECT author AS src, changedpath AS dst, count(*) AS w FROM changes JOIN revisions USING (revno) GROUP BY 1, 2)
        WHERE w >= 1.1"""),
    "file_network": _o("SELECT src, dst, round(weight, 4) AS weight FROM core", HEAVY_LINKS, _core(5)),
    "drop_node": _n("""SELECT author AS src, changedpath AS dst, CAST(count(*) AS DOUBLE) AS weight
        FROM changes JOIN revisions USING (revno) WHERE author <> 'NATION_3' GROUP BY 1, 2 HAVING count(*) >= 2"""),
    "coauthor_edges": _n("SELECT * FROM co", COAUTHOR),
    "coauthor_matrix": _n("""SELECT a.author AS src, b.author AS dst, coalesce(w, 0) AS weight
        FROM (SELECT DISTINCT author FROM revisions) a CROSS JOIN (SELECT DISTINCT author FROM revisions) b
        LEFT JOIN (SELECT x.author AS s, y.author AS t, CAST(sum(y.linesadded) AS BIGINT) AS w FROM r x JOIN r y
                   ON x.changedpath = y.changedpath AND y.revno <= x.revno GROUP BY 1, 2) m
          ON m.s = a.author AND m.t = b.author""",
        "r AS (SELECT author, changedpath, revno, linesadded FROM changes JOIN revisions USING (revno))"),
    "degree_centrality": _o("""SELECT node, count(*) AS degree,
          round(count(*) / CAST((SELECT count(*) FROM (SELECT DISTINCT u FROM g)) - 1 AS DOUBLE), 4) AS centrality
        FROM (SELECT u AS node, v FROM g) GROUP BY 1""",
        """pairs AS (SELECT DISTINCT author AS a, changedpath AS b FROM changes JOIN revisions USING (revno)),
        g AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs)"""),
    "k_core": _o("SELECT * FROM core", ALL_LINKS, _core(5)),
    "connected_components": _o("SELECT node, component FROM comp", AUTHOR_NETWORK, COMPONENTS),
    "largest_component": _o("""SELECT e.* FROM e JOIN comp ON node = src WHERE component = (
          SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)""", AUTHOR_NETWORK, COMPONENTS),
    "components_min_size": _o("""SELECT component, node, n AS size FROM comp JOIN (
          SELECT component, count(*) AS n FROM comp GROUP BY 1 HAVING count(*) >= 10) USING (component)""", AUTHOR_NETWORK, COMPONENTS),
    "closeness_centrality": _o("SELECT node, round(closeness, 4) AS closeness FROM close", AUTHOR_NETWORK, DISTANCES),
    "graph_stats": _o("""SELECT count(*) AS n_nodes, min(ecc) AS radius, max(ecc) AS diameter,
          (SELECT count(*) FROM e) AS n_edges FROM close""", AUTHOR_NETWORK, DISTANCES),
    "graph_stats_file_network": _network("""SELECT count(*) AS n_nodes, min(ecc) AS radius, max(ecc) AS diameter,
          (SELECT count(*) FROM e) AS n_edges FROM close""", NEAR_DISTANCES),
    "graph_center": _network("SELECT node, ecc AS eccentricity FROM close WHERE ecc = (SELECT min(ecc) FROM close)", NEAR_DISTANCES),
    "closeness_file_network": _network("SELECT node, round(closeness, 4) AS closeness FROM close", NEAR_DISTANCES),
    "betweenness": _o("SELECT node, round(b, 4) AS betweenness FROM nb", AUTHOR_NETWORK, DISTANCES, PATHS),
    "edge_betweenness": _o("SELECT src, dst, round(total / (n * (n - 1)), 4) AS betweenness FROM eb, nn",
        AUTHOR_NETWORK, DISTANCES, PATHS),
    "trim_by_edge_betweenness": _o("""SELECT e.src, e.dst, e.weight FROM e JOIN eb ON eb.src = least(e.src, e.dst) AND eb.dst = greatest(e.src, e.dst)
        JOIN place ON place.node = e.src
        JOIN (SELECT component, count(*) AS n, avg(total) + stddev_pop(total) AS lim FROM eb JOIN place ON node = src GROUP BY 1) l
          ON l.component = place.component
        WHERE n <= 3 OR total <= lim""", AUTHOR_NETWORK, DISTANCES, PATHS,
        "place AS (SELECT s AS node, min(v) AS component FROM dist GROUP BY 1)"),
    "degree_over_time": _n("""SELECT author, strftime(day, '%Y-%m-%d') AS day, CAST(deg AS BIGINT) AS degree,
          round(deg / CAST(nodes - 1 AS DOUBLE), 4) AS centrality
        FROM (SELECT author, d.day, (SELECT count(*) FROM links l WHERE l.author = a.author AND l.day <= d.day) AS deg, nodes
              FROM (SELECT author, min(day) AS born FROM links GROUP BY 1) a JOIN nodes_on d ON d.day >= a.born)""",
        FIRST_LINKS,
        """born AS (SELECT min(day) AS day FROM links GROUP BY author UNION ALL SELECT min(day) FROM links GROUP BY changedpath),
        nodes_on AS (SELECT day, (SELECT count(*) FROM born b WHERE b.day <= x.day) AS nodes FROM (
             SELECT DISTINCT CAST(commitdate AS DATE) AS day FROM revisions WHERE revno IN (SELECT revno FROM changes)) x)"""),
    "closeness_over_time": _n("""SELECT substr(author, 3) AS author, strftime(day, '%Y-%m-%d') AS day,
          round(CASE WHEN d > 0 AND nodes > 1 THEN r / CAST(d AS DOUBLE) * r / (nodes - 1) ELSE 0 END, 4) AS closeness
        FROM (SELECT o.author, o.day, nodes, sum(r) - 1 AS r, sum(c.d) AS d FROM (
                SELECT s AS author, min(t) AS born FROM hop WHERE h = 0 GROUP BY 1) a
              JOIN (SELECT DISTINCT s AS author, n.day, nodes FROM hop, nodes_on n) o ON o.author = a.author AND o.day >= born
              JOIN changed c ON c.s = o.author AND c.day <= o.day GROUP BY 1, 2, 3)""",
        FIRST_LINKS, NODES_ON, HOPS_BY_DAY),
    "centrality_over_time": _n("""SELECT substr(x.author, 3) AS author, strftime(x.day, '%Y-%m-%d') AS day,
          CAST(deg AS BIGINT) AS degree, round(deg / CAST(nodes - 1 AS DOUBLE), 4) AS centrality,
          round(CASE WHEN d > 0 AND nodes > 1 THEN r / CAST(d AS DOUBLE) * r / (nodes - 1) ELSE 0 END, 4) AS closeness
        FROM (SELECT o.author, o.day, nodes, sum(r) - 1 AS r, sum(c.d) AS d, sum(c.near) AS deg FROM (
                SELECT s AS author, min(t) AS born FROM hop WHERE h = 0 GROUP BY 1) a
              JOIN (SELECT DISTINCT s AS author, n.day, nodes FROM hop, nodes_on n) o ON o.author = a.author AND o.day >= born
              JOIN changed c ON c.s = o.author AND c.day <= o.day GROUP BY 1, 2, 3) x""",
        FIRST_LINKS, NODES_ON, HOPS_BY_DAY),
    "weighted_closeness": _o("""SELECT s AS node, round((count(*) - 1) / sum(d) * (count(*) - 1)
          / ((SELECT count(DISTINCT u) FROM lg) - 1), 4) AS closeness
        FROM (SELECT * FROM relax WHERE it = (SELECT max(it) FROM relax)) GROUP BY 1""", AUTHOR_NETWORK, LENGTHS, RELAX),
    "minimum_spanning_tree": _o("""SELECT src, dst, round(len, 4) AS weight FROM ranked r
        WHERE NOT EXISTS (SELECT 1 FROM grow WHERE grow.r = r.r AND node = dst)""", AUTHOR_NETWORK, LENGTHS,
        """ranked AS (SELECT u AS src, v AS dst, len, row_number() OVER (ORDER BY len, u, v) AS r FROM lg WHERE u < v),
        grow(r, node) AS (SELECT r, src FROM ranked UNION
          SELECT g.r, CASE WHEN x.src = g.node THEN x.dst ELSE x.src END FROM grow g
          JOIN ranked x ON (x.src = g.node OR x.dst = g.node) AND x.r < g.r)"""),
    "betweenness_tree": _o("""SELECT d.node, d.parent, d.root, CAST(d.depth AS BIGINT) AS depth, CAST(below AS BIGINT) AS size,
          round((reached - 1) / far_sum * (reached - 1) / (n - 1), 4) AS closeness, round(b, 4) AS betweenness
        FROM down d JOIN (SELECT top, count(*) AS below FROM above GROUP BY 1) ON top = d.node JOIN nb ON nb.node = d.node
        JOIN (SELECT s, count(*) AS reached, sum(d) AS far_sum FROM relax WHERE it = (SELECT max(it) FROM relax) GROUP BY 1) ON s = d.node, nn""",
        AUTHOR_NETWORK, DISTANCES, PATHS, LENGTHS, RELAX,
        """ranked AS (SELECT src, dst, row_number() OVER (ORDER BY round(total, 6), src, dst) AS r FROM eb),
        grow(r, node) AS (SELECT r, src FROM ranked UNION
          SELECT g.r, CASE WHEN x.src = g.node THEN x.dst ELSE x.src END FROM grow g
          JOIN ranked x ON (x.src = g.node OR x.dst = g.node) AND x.r < g.r),
        tree AS (SELECT src, dst FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM grow WHERE grow.r = r.r AND node = dst)),
        twigs AS (SELECT src AS u, dst AS v FROM tree UNION ALL SELECT dst, src FROM tree),
        tops AS (SELECT node FROM (SELECT s AS node, min(v) AS component FROM dist GROUP BY 1) JOIN nb USING (node)
          QUALIFY row_number() OVER (PARTITION BY component ORDER BY round(b, 9) DESC, node) = 1),
        down(node, parent, root, depth) AS (SELECT node, CAST(NULL AS VARCHAR), node, 0 FROM tops UNION ALL
          SELECT v, d.node, root, depth + 1 FROM down d JOIN twigs ON u = d.node AND v IS DISTINCT FROM d.parent),
        above(top, node) AS (SELECT node, node FROM down UNION ALL SELECT d.parent, a.node FROM above a JOIN down d ON d.node = a.top WHERE d.parent IS NOT NULL)"""),
    "path_treemap": _network("""SELECT node, CASE WHEN depth > 0 THEN regexp_extract(node, '^(.*)/[^/]*$', 1) END AS parent,
          regexp_extract(node, '([^/]*)$', 1) AS name, depth, CAST(sum(n) AS BIGINT) AS size,
          round(max(CASE WHEN depth = 4 THEN c ELSE 0 END), 4) AS centrality
        FROM (SELECT depth, n, c, 'Root' || CASE WHEN depth > 0 THEN '/' || array_to_string(parts[1:depth], '/') ELSE '' END AS node
              FROM leaves, range(5) t(depth)) GROUP BY 1, 2, 3, 4""", ORDERS, NEAR_DISTANCES,
        """big AS (SELECT component, row_number() OVER (ORDER BY any_value(size) DESC, component) AS no FROM close
             WHERE size > 10 GROUP BY 1),
        leaves AS (SELECT string_split('subgraph ' || CAST(no AS VARCHAR) || node, '/') AS parts, n, inner_closeness AS c
             FROM close JOIN big USING (component)
             JOIN (SELECT changedpath, count(*) AS n FROM changes GROUP BY 1) ON changedpath = node)"""),
    "author_nodes": _o("SELECT id, label FROM nodes", NODES),
    "numbered_edges": _n("""SELECT row_number() OVER (ORDER BY substr(md5(src || chr(0) || dst), 1, 3), src, dst) - 1 AS id,
          a.id AS source, b.id AS target, weight
        FROM co JOIN nodes a ON a.label = src JOIN nodes b ON b.label = dst""", COAUTHOR, NODES),
})

ORACLES.update({
    # Sources and sinks
    "read_revisions": _o("""SELECT revno, strftime(any_value(commitdate), '%Y-%m-%d %H:%M:%S.%f') AS commitdate,
          any_value(author) AS author, any_value(msg) AS msg,
          count(*) FILTER (changetype = 'A') AS added_files, count(*) FILTER (changetype IN ('M', 'R')) AS changed_files,
          count(*) FILTER (changetype = 'D') AS deleted_files
        FROM revisions LEFT JOIN changes USING (revno) GROUP BY revno"""),
    "read_changes": _o("""SELECT changedpath, changetype, count(*) AS n, CAST(sum(linesadded) AS BIGINT) AS lines
        FROM changes GROUP BY 1, 2"""),
    "write_stats_csv": _o("""
        SELECT 'basic' AS section, name, value FROM (
          SELECT unnest(['Repository Name', 'Search Path', 'First Revision no.', 'Latest Revision no.', 'Number of Revisions',
                         'Number of active files', 'Number of authors', 'Total Number of Lines',
                         'First Commit Date', 'Last Commit Date']) AS name,
                 unnest(['orders', '/', CAST(lo AS VARCHAR), CAST(hi AS VARCHAR), CAST(n AS VARCHAR), CAST(f AS VARCHAR),
                         CAST(a AS VARCHAR), CAST(l AS VARCHAR), strftime(d0, '%b %d, %Y %I:%M %p'), strftime(d1, '%b %d, %Y %I:%M %p')]) AS value
          FROM (SELECT min(revno) AS lo, max(revno) AS hi, count(*) AS n, count(DISTINCT author) AS a,
                       arg_min(commitdate, revno) AS d0, arg_max(commitdate, revno) AS d1 FROM revisions),
               (SELECT count(*) FILTER (changetype = 'A') - count(*) FILTER (changetype = 'D') AS f,
                       CAST(sum(linesadded - linesdeleted) AS BIGINT) AS l FROM changes))
        UNION ALL SELECT 'authors', author, printf('%.3f', t) FROM (
          SELECT author, 1.1 + 10 * sum(x) - 1.1 * min(x) AS t FROM (
            SELECT author, exp(-0.0025 * (epoch_us(CAST(end_day AS TIMESTAMP)) - epoch_us(commitdate)) / 3.6e9) AS x
            FROM revisions, (SELECT CAST(max(commitdate) AS DATE) + 1 AS end_day FROM revisions)) GROUP BY 1
          ORDER BY 2 DESC, 1 LIMIT 10)
        UNION ALL SELECT 'files', changedpath, printf('%.3f', temp) FROM (
          SELECT * FROM final ORDER BY temp DESC, changedpath LIMIT 10)
        UNION ALL SELECT 'weekday', ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][i + 1], CAST(count(revno) AS VARCHAR)
          FROM range(7) t(i) LEFT JOIN revisions ON dayofweek(commitdate) = i GROUP BY i
        UNION ALL SELECT 'hour', CAST(i AS VARCHAR), CAST(count(revno) AS VARCHAR)
          FROM range(24) t(i) LEFT JOIN revisions ON hour(commitdate) = i GROUP BY i""", FILE_FOLD, FILE_FINAL),
    "query_to_csv": _o("""SELECT author, CAST(sum(linesadded) AS BIGINT) AS lines
        FROM revisions JOIN changes USING (revno) GROUP BY 1"""),
    "write_series_json": ORACLES["waste_effort"],
    "graph_export": ORACLES["numbered_edges"],
    "treemap_export": _o("""SELECT node, CASE WHEN depth > 0 THEN regexp_extract(node, '^(.*)/[^/]*$', 1) END AS parent,
          regexp_extract(node, '([^/]*)$', 1) AS name, depth, count(*) AS size
        FROM (SELECT depth, 'Root' || CASE WHEN depth > 0 THEN '/' || array_to_string(parts[1:depth], '/') ELSE '' END AS node
              FROM (SELECT string_split(substr(changedpath, 2), '/') AS parts FROM changes), range(4) t(depth))
        GROUP BY 1, 2, 3, 4"""),
})

ORACLES["read_revisions_parquet"] = ORACLES["read_revisions"]
