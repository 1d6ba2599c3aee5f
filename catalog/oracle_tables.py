"""Named tables for the SQL side, in the oracle's own dialect and way of working."""

from __future__ import annotations

_RAW = r"""
b AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
g AS (SELECT k,
  CASE WHEN k % 211 = 0 THEN NULL ELSE concat('g', k::VARCHAR) END AS uuid,
  concat('https://games.test/', k::VARCHAR) AS url,
  concat('t', k::VARCHAR) AS tcn,
  CASE k % 6 WHEN 0 THEN '60' WHEN 1 THEN '180+2' WHEN 2 THEN '600' WHEN 3 THEN '300+5' WHEN 4 THEN '1/259200' ELSE '500' END AS time_control,
  CASE k % 6 WHEN 0 THEN 'bullet' WHEN 1 THEN 'blitz' WHEN 2 THEN 'rapid' WHEN 3 THEN 'blitz' WHEN 4 THEN 'daily' ELSE 'rapid' END AS time_class,
  CAST(1704067200 + (k * 7919) % 31536000 AS BIGINT) AS end_time,
  k % 5 <> 0 AS rated,
  CASE WHEN k % 20 = 0 THEN 'chess960' ELSE 'chess' END AS rules,
  'f' AS fen, 'start' AS initial_setup,
  CASE WHEN k % 101 = 0 THEN NULL ELSE concat('Player', CAST(c % 12 AS VARCHAR)) END AS white_username,
  concat('Player', CAST((c % 12 + 1 + k % 11) % 12 AS VARCHAR)) AS black_username,
  CAST(800 + (k * 37) % 1700 AS BIGINT) AS white_rating,
  CAST(800 + (k * 53) % 1700 AS BIGINT) AS black_rating,
  CASE k % 4 WHEN 0 THEN 'resigned' WHEN 1 THEN 'checkmated' WHEN 2 THEN 'timeout' ELSE 'abandoned' END AS lost,
  CASE k % 6 WHEN 0 THEN 'agreed' WHEN 1 THEN 'stalemate' WHEN 2 THEN 'repetition' WHEN 3 THEN 'insufficient' WHEN 4 THEN 'timevsinsufficient' ELSE '50move' END AS drawn,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 50 + CAST(k % 400 AS DOUBLE) / 10 END AS white_accuracy,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 50 + CAST(k % 450 AS DOUBLE) / 10 END AS black_accuracy,
  CAST(1735689600 + k % 1000 AS BIGINT) AS uploaded_epoch,
  CASE k % 9 WHEN 0 THEN 'Sicilian-Defense-Najdorf-Variation' WHEN 1 THEN 'Italian-Game-Two-Knights'
    WHEN 2 THEN 'Queens-Gambit-Declined' WHEN 3 THEN 'London-System' WHEN 4 THEN 'Caro-Kann-Defense'
    WHEN 5 THEN 'Kings-Indian-Attack' WHEN 6 THEN 'English-Opening' WHEN 7 THEN 'Ruy-Lopez' ELSE NULL END AS slug,
  5 + k % 40 AS n, CAST(floor(k / 40) AS BIGINT) AS j
  FROM b),
p AS (SELECT *,
  CASE WHEN k % 7 < 3 THEN 'win' WHEN k % 7 < 6 THEN lost ELSE drawn END AS white_result,
  CASE WHEN k % 7 < 3 THEN lost WHEN k % 7 < 6 THEN 'win' ELSE drawn END AS black_result,
  concat('[Date "', strftime(make_timestamp(end_time * 1000000), '%Y.%m.%d'), '"]', chr(10),
    '[StartTime "', strftime(make_timestamp((end_time - (30 + k % 1500)) * 1000000), '%H:%M:%S'), '"]', chr(10),
    '[EndTime "', strftime(make_timestamp(end_time * 1000000), '%H:%M:%S'), '"]', chr(10),
    CASE WHEN slug IS NULL THEN '' ELSE concat('[ECOUrl "https://www.chess.com/openings/', slug, '"]', chr(10)) END,
    '[Link "', url, '"]', chr(10), chr(10),
    array_to_string(list_transform(range(1, n + 1), lambda i:
      concat(CAST(i AS VARCHAR), '. ',
        CASE WHEN i = 6 AND k % 3 = 0 THEN 'O-O' WHEN i = 7 AND k % 5 = 1 THEN 'O-O-O' WHEN i = 40 THEN 'e8=Q' ELSE 'Nf3' END,
        ' {[%clk 0:0', CAST(greatest(0, 4 - CAST(floor(i / 9) AS INT)) AS VARCHAR), ':',
        lpad(CAST((i * 7 + j) % 60 AS VARCHAR), 2, '0'), CASE WHEN i % 2 = 0 THEN '.5' ELSE '' END, ']}',
        CASE WHEN i = n AND k % 2 = 1 THEN '' ELSE concat(' ', CAST(i AS VARCHAR), '... ',
          CASE WHEN i = 6 AND k % 4 = 0 THEN 'O-O' WHEN i = 8 AND k % 5 = 2 THEN 'O-O-O' WHEN i = 42 THEN 'd1=N' ELSE 'Nc6' END,
          ' {[%clk 0:0', CAST(greatest(0, 4 - CAST(floor(i / 9) AS INT)) AS VARCHAR), ':',
          lpad(CAST((i * 7 + j + 13) % 60 AS VARCHAR), 2, '0'), CASE WHEN i % 2 = 0 THEN '.5' ELSE '' END, ']}') END)), ' '),
    ' *') AS pgn FROM g),
landed AS (
  SELECT uuid, url, tcn, pgn, time_control, end_time, rated, time_class, rules, fen, initial_setup,
    white_username, white_rating, white_result, md5(white_username) AS white_uuid,
    black_username, black_rating, black_result, md5(black_username) AS black_uuid,
    white_accuracy, black_accuracy, uploaded_epoch, coalesce(white_username, black_username) AS loaded_by_user FROM p
  UNION ALL
  SELECT uuid, url, tcn, pgn, time_control, end_time, rated, time_class, rules, fen, initial_setup,
    white_username, white_rating, white_result, md5(white_username),
    black_username, black_rating, black_result, md5(black_username),
    99.5, black_accuracy, uploaded_epoch + 86400, black_username FROM p WHERE k % 50 = 0),
raw AS (
  SELECT * EXCLUDE (uploaded_epoch, loaded_by_user),
    make_timestamp(uploaded_epoch * 1000000) AS uploaded_at, loaded_by_user FROM landed)"""

_STG = r"""
latest AS (
  SELECT DISTINCT ON (uuid) * FROM raw
  WHERE uuid IS NOT NULL AND end_time IS NOT NULL AND white_username IS NOT NULL AND black_username IS NOT NULL
  ORDER BY uuid, uploaded_at DESC, loaded_by_user DESC, end_time DESC),
timed AS (SELECT *, make_timestamp(end_time * 1000000) AS ended FROM latest),
stg AS (
  SELECT uuid AS game_id, url AS game_url, tcn, ended AS game_end_timestamp, ended::DATE AS game_date,
    date_part('year', ended)::INTEGER AS game_year, date_part('month', ended)::INTEGER AS game_month,
    date_part('day', ended)::INTEGER AS game_day, date_part('hour', ended)::INTEGER AS game_hour,
    (date_part('dow', ended) + 1)::INTEGER AS game_day_of_week, dayname(ended) AS game_weekday_name,
    time_control AS raw_time_control, time_class, rules, rated, fen AS final_fen, initial_setup, pgn,
    white_username, white_rating, white_result, white_uuid, white_accuracy,
    black_username, black_rating, black_result, black_uuid, black_accuracy,
    uploaded_at, loaded_by_user
  FROM timed)"""

_PG = r"""
sides AS (
  SELECT stg.*, 'white' AS my_color, white_username AS my_username, white_rating AS my_rating, white_result AS my_result,
    white_accuracy AS my_accuracy, black_username AS opp_username, black_rating AS opp_rating,
    black_result AS opp_result, black_accuracy AS opp_accuracy FROM stg
  UNION ALL
  SELECT stg.*, 'black', black_username, black_rating, black_result, black_accuracy,
    white_username, white_rating, white_result, white_accuracy FROM stg),
slugged AS (
  SELECT *, nullif(regexp_extract(pgn, '\[ECOUrl "https?://[^"]+/openings/([^"]+)"\]', 1), '') AS slug,
    my_rating - opp_rating AS rating_diff,
    if(my_result = 'win', 'win', if(list_contains(['draw', 'stalemate', 'repetition', 'insufficient',
      'timevsinsufficient', 'agreed', '50move'], my_result), 'draw', 'lose')) AS outcome
  FROM sides),
named AS (
  SELECT *, coalesce(slug, 'No-Opening') AS eco_slug_raw,
    coalesce(nullif(regexp_extract(slug, '^.+?(Defense|Gambit|Opening|Game|Attack|System)', 0), ''), slug, 'No Opening') AS eco
  FROM slugged),
pg AS (
  SELECT md5(game_id || '-' || my_username) AS player_game_key, * EXCLUDE (slug, pgn, tcn, final_fen, initial_setup,
      white_username, white_rating, white_result, white_uuid, white_accuracy,
      black_username, black_rating, black_result, black_uuid, black_accuracy),
    if(eco <> 'No Opening' AND (my_color = 'black') = contains(eco, 'Defense'), eco, 'N/A') AS my_opening,
    format('{}_{}', my_username, game_year) AS username_year
  FROM named)"""

_DAILY = r"""
perday AS (
  SELECT my_username AS username, game_date AS stat_date, time_class, count(*) AS games_played,
    count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'lose') AS losses,
    count(*) FILTER (outcome = 'draw') AS draws,
    sum(my_accuracy::DECIMAL(38,18))::DOUBLE / count(my_accuracy)::DOUBLE AS avg_accuracy,
    avg(my_rating) AS avg_rating, max(my_rating) AS max_rating, min(my_rating) AS min_rating,
    arg_max(my_rating, game_end_timestamp) FILTER (my_rating IS NOT NULL) AS closing_rating,
    max(game_end_timestamp) AS last_game_at
  FROM pg GROUP BY ALL),
running AS (
  SELECT d.*, (SELECT sum(e.games_played) FROM perday e WHERE e.username = d.username AND e.time_class = d.time_class
                 AND e.stat_date <= d.stat_date)::BIGINT AS total_games,
    (SELECT sum(e.wins) FROM perday e WHERE e.username = d.username AND e.time_class = d.time_class
       AND e.stat_date <= d.stat_date)::BIGINT AS total_wins,
    (SELECT max(e.max_rating) FROM perday e WHERE e.username = d.username AND e.time_class = d.time_class
       AND e.stat_date <= d.stat_date) AS highest_rating_ever
  FROM perday d),
ustats AS (
  SELECT md5(concat_ws('-', username, stat_date::VARCHAR, time_class)) AS stat_key, md5(username) AS user_key,
    username, stat_date, time_class, games_played, wins, losses, draws,
    round(avg_accuracy::DECIMAL(20, 10), 2)::DOUBLE AS avg_accuracy,
    round(avg_rating::DECIMAL(20, 10), 1)::DOUBLE AS avg_rating, max_rating, min_rating, closing_rating,
    total_games, total_wins, closing_rating AS current_rating, highest_rating_ever
  FROM running)"""

_USERS = r"""
roster AS (SELECT white_username AS username FROM stg UNION SELECT black_username FROM stg),
life AS (
  SELECT my_username AS username, max(game_date) AS last_game_date, min(game_date) AS first_game_date,
    count(DISTINCT game_date) AS active_days, count(*) AS total_games,
    count(*) FILTER (outcome = 'win') AS total_wins, count(*) FILTER (outcome = 'lose') AS total_losses,
    count(*) FILTER (outcome = 'draw') AS total_draws,
    arg_max(my_rating, game_end_timestamp) FILTER (my_rating IS NOT NULL) AS current_rating,
    max(my_rating) AS peak_rating, min(my_rating) AS lowest_rating,
    count(*) FILTER (time_class = 'blitz') AS blitz_games, count(*) FILTER (time_class = 'rapid') AS rapid_games,
    count(*) FILTER (time_class = 'bullet') AS bullet_games, count(*) FILTER (time_class = 'daily') AS daily_games
  FROM pg GROUP BY 1),
dim AS (
  SELECT md5(username) AS user_key, username, ifnull(current_rating, 0) AS current_rating, ifnull(peak_rating, 0) AS peak_rating,
    ifnull(lowest_rating, 0) AS lowest_rating, ifnull(last_game_date, DATE '1970-01-01') AS last_game_date,
    ifnull(first_game_date, DATE '1970-01-01') AS first_game_date, ifnull(active_days, 0) AS active_days,
    ifnull(total_games, 0) AS total_games, ifnull(total_wins, 0) AS total_wins, ifnull(total_losses, 0) AS total_losses,
    ifnull(total_draws, 0) AS total_draws, round(total_wins / total_games, 4) AS win_rate,
    ifnull(blitz_games, 0) AS blitz_games, ifnull(rapid_games, 0) AS rapid_games,
    ifnull(bullet_games, 0) AS bullet_games, ifnull(daily_games, 0) AS daily_games
  FROM roster LEFT JOIN life USING (username))"""

_RUNS = r"""
spots AS (
  SELECT my_username, time_class, game_id, game_date, game_end_timestamp, outcome,
    row_number() OVER (PARTITION BY my_username, time_class ORDER BY game_end_timestamp, game_id) AS nth
  FROM pg),
marked AS (
  SELECT s.*, (coalesce(b.outcome <> s.outcome, false))::INTEGER AS outcome_changed
  FROM spots s LEFT JOIN spots b ON b.my_username = s.my_username AND b.time_class = s.time_class AND b.nth = s.nth - 1),
grouped AS (
  SELECT * EXCLUDE nth, (sum(outcome_changed) OVER (PARTITION BY my_username, time_class ORDER BY nth))::BIGINT AS streak_group
  FROM marked),
runs AS (
  SELECT my_username, time_class, outcome, streak_group, count(*) AS streak_length,
    min(game_date) AS streak_start, max(game_date) AS streak_end
  FROM grouped GROUP BY ALL),
best AS (
  SELECT my_username, time_class, max(streak_length) FILTER (outcome = 'win') AS longest_win_streak,
    max(streak_length) FILTER (outcome = 'lose') AS longest_loss_streak,
    arg_max(outcome, streak_group) AS current_streak_outcome, arg_max(streak_length, streak_group) AS current_streak_length
  FROM runs GROUP BY ALL)"""

_MYDAILY = r"""
mydaily AS (
  SELECT r.username AS my_username, stat_date AS game_date, year(stat_date)::INTEGER AS game_year,
    month(stat_date)::INTEGER AS game_month, r.time_class, games_played, wins, losses, draws,
    round(wins / games_played, 4) AS win_rate, closing_rating, max_rating AS day_peak_rating, min_rating AS day_low_rating,
    avg_accuracy, highest_rating_ever AS peak_rating_ever, total_games, total_wins,
    longest_win_streak, longest_loss_streak, current_streak_outcome, current_streak_length, last_game_at
  FROM running r LEFT JOIN best ON best.my_username = r.username AND best.time_class = r.time_class)"""

# Header, moves and clocks of every landed row that has a record text.
_PARSE = r"""
texts AS (
  SELECT *, regexp_extract(pgn, '\[Date "([^"]*)"\]', 1) AS t_date,
    regexp_extract(pgn, '\[StartTime "([^"]*)"\]', 1) AS t_start, regexp_extract(pgn, '\[EndTime "([^"]*)"\]', 1) AS t_end,
    regexp_extract(pgn, '\[Link "([^"]*)"\]', 1) AS link, nullif(regexp_extract(pgn, '\[ECOUrl "([^"]*)"\]', 1), '') AS eco_link,
    list_filter(string_split_regex(trim(regexp_replace(pgn, '\[[^\n]*?\]\n', '', 'g')), '\s+'), lambda w:
      NOT contains(w, '.') AND NOT starts_with(w, '{') AND regexp_matches(w, '[=[:alpha:]]')) AS moves,
    regexp_extract_all(pgn, '(\d+)\. \S+ \{\[%clk ([0-9:]+(?:\.[0-9]+)?)\]\}', 1) AS white_nos,
    regexp_extract_all(pgn, '(\d+)\. \S+ \{\[%clk ([0-9:]+(?:\.[0-9]+)?)\]\}', 2) AS white_clks,
    regexp_extract_all(pgn, '(\d+)\.\.\. \S+ \{\[%clk ([0-9:]+(?:\.[0-9]+)?)\]\}', 1) AS black_nos,
    regexp_extract_all(pgn, '(\d+)\.\.\. \S+ \{\[%clk ([0-9:]+(?:\.[0-9]+)?)\]\}', 2) AS black_clks
  FROM raw WHERE pgn IS NOT NULL),
clocked AS (
  SELECT *, date_part('epoch', t_start::TIME)::BIGINT AS start_s, date_part('epoch', t_end::TIME)::BIGINT AS end_s,
    strptime(t_date, '%Y.%m.%d')::DATE AS utc_day,
    CASE WHEN time_control LIKE '%/%' THEN NULL
      ELSE list_sum(list_transform(string_split(time_control, '+'), lambda v: v::BIGINT))::DOUBLE END AS control_s,
    string_split(time_control, '+')[1] AS base_text, coalesce(string_split(time_control, '+')[2], '0') AS inc_text,
    list_filter(moves, lambda m, i: i % 2 = 1) AS white_moves, list_filter(moves, lambda m, i: i % 2 = 0) AS black_moves
  FROM texts),
parsed AS (
  SELECT uuid, url, tcn, time_control AS raw_control, end_time, rated, time_class, rules, fen, initial_setup,
    white_username, white_rating, white_result, black_username, black_rating, black_result, uploaded_at, loaded_by_user,
    link, eco_link, moves, white_moves, black_moves, white_nos, white_clks, black_nos, black_clks, control_s, utc_day,
    (start_s + 68400) % 86400 AS start_est_s, (end_s + 68400) % 86400 AS end_est_s,
    utc_day - (CASE WHEN (start_s + 68400) % 86400 > 68400 THEN 1 ELSE 0 END)::INTEGER AS local_day,
    strftime(make_timestamp(((start_s + 68400) % 86400) * 1000000), '%H:%M:%S') AS start_time_est,
    strftime(make_timestamp(((end_s + 68400) % 86400) * 1000000), '%H:%M:%S') AS end_time_est,
    (end_s - start_s + 86400) % 86400 AS time_spent,
    CASE WHEN time_control LIKE '%/%' THEN printf('%.1f day(s) per move',
        string_split(time_control, '/')[1]::DOUBLE / (string_split(time_control, '/')[2]::DOUBLE / 86400))
      ELSE concat(CASE WHEN base_text::INT >= 60 THEN concat(base_text::INT // 60, 'm') ELSE '' END,
        CASE WHEN base_text::INT >= 60 AND base_text::INT % 60 > 0 THEN ' ' ELSE '' END,
        CASE WHEN base_text::INT < 60 OR base_text::INT % 60 > 0 THEN concat(base_text::INT % 60, 's') ELSE '' END,
        ' + ', inc_text, 's') END AS control_label,
    coalesce(nullif(regexp_extract(regexp_extract(coalesce(eco_link, ''), 'https?://[^"]+/openings/([^"]+)', 1),
      '^.+?(Defense|Gambit|Opening|Game|Attack|System)', 0), ''),
      nullif(regexp_extract(coalesce(eco_link, ''), 'https?://[^"]+/openings/([^"]+)', 1), ''), 'No Opening') AS eco,
    len(white_clks) AS white_n, len(black_clks) AS black_n,
    (string_split(white_clks[-1], ':')[1]::DOUBLE * 3600 + string_split(white_clks[-1], ':')[2]::DOUBLE * 60
      + string_split(white_clks[-1], ':')[3]::DOUBLE) AS white_last,
    (string_split(black_clks[-1], ':')[1]::DOUBLE * 3600 + string_split(black_clks[-1], ':')[2]::DOUBLE * 60
      + string_split(black_clks[-1], ':')[3]::DOUBLE) AS black_last,
    CASE WHEN list_contains(white_moves, 'O-O-O') THEN 'queenside' WHEN list_contains(white_moves, 'O-O') THEN 'kingside' ELSE 'none' END AS white_castling,
    CASE WHEN list_contains(black_moves, 'O-O-O') THEN 'queenside' WHEN list_contains(black_moves, 'O-O') THEN 'kingside' ELSE 'none' END AS black_castling,
    len(list_filter(white_moves, lambda m: contains(m, '='))) AS white_promotions,
    len(list_filter(black_moves, lambda m: contains(m, '='))) AS black_promotions,
    len(list_filter(white_moves, lambda m: contains(m, 'e.p.'))) AS white_passant,
    len(list_filter(black_moves, lambda m: contains(m, 'e.p.'))) AS black_passant
  FROM clocked),
games AS (
  SELECT DISTINCT ON (uuid) * FROM parsed
  WHERE uuid IS NOT NULL AND end_time IS NOT NULL AND white_username IS NOT NULL AND black_username IS NOT NULL
  ORDER BY uuid, uploaded_at DESC, loaded_by_user DESC, end_time DESC),
seen AS (
  SELECT g.*, 'white' AS my_color, white_username AS my_username, white_rating AS my_rating, white_result AS my_result,
    white_moves AS my_moves, white_n AS my_num_moves, white_last AS my_last, white_castling AS my_castling,
    black_username AS opp_username, black_rating AS opp_rating, black_result AS opp_result, black_moves AS opp_moves,
    black_n AS opp_num_moves, black_last AS opp_last, black_castling AS opp_castling,
    white_promotions AS promotion_count, white_passant AS en_passant_count FROM games g
  UNION ALL
  SELECT g.*, 'black', black_username, black_rating, black_result, black_moves, black_n, black_last, black_castling,
    white_username, white_rating, white_result, white_moves, white_n, white_last, white_castling,
    black_promotions, black_passant FROM games g),
judged AS (
  SELECT * EXCLUDE eco, eco, uuid AS game_id, make_timestamp(end_time * 1000000) AS ended, my_rating - opp_rating AS rating_diff,
    if(my_result = 'win', 'win', if(list_contains(['draw', 'stalemate', 'repetition', 'insufficient',
      'timevsinsufficient', 'agreed', '50move'], my_result), 'draw', 'lose')) AS outcome,
    if(eco <> 'No Opening' AND (my_color = 'black') = contains(eco, 'Defense'), eco, 'N/A') AS my_opening,
    if(my_num_moves > opp_num_moves, 'me', 'opponent') AS last_mover
  FROM seen),
clean AS (
  SELECT *, local_day AS date,
    if(my_result = 'timeout' OR (my_result = 'timevsinsufficient' AND last_mover = 'opponent'), 0.0::DOUBLE,
       coalesce(my_last, control_s)) AS my_time_left,
    if(opp_result = 'timeout' OR (opp_result = 'timevsinsufficient' AND last_mover = 'me'), 0.0::DOUBLE,
       coalesce(opp_last, control_s)) AS opp_time_left
  FROM judged),
an AS (
  SELECT *, my_time_left / control_s AS my_time_left_ratio, opp_time_left / control_s AS opp_time_left_ratio
  FROM clean
  WHERE rules = 'chess' AND time_class IN ('blitz', 'rapid', 'bullet', 'daily') AND control_s > 0
    AND link IS NOT NULL AND date IS NOT NULL AND my_rating IS NOT NULL AND opp_rating IS NOT NULL AND my_result IS NOT NULL AND opp_result IS NOT NULL)"""

_TRACKED = r"""
tracked AS (
  SELECT upper(loaded_by_user) AS username, min(uploaded_at)::DATE AS added_at, 'loads own games' AS notes
  FROM raw WHERE loaded_by_user IN ('Player0', 'Player1', 'Player2', 'Player3', 'Player4', 'Player5', 'Player6', 'Player7', 'Player8', 'Player9') GROUP BY 1
  UNION ALL
  SELECT r_name, DATE '2025-02-01', 'no games yet' FROM region)"""

_TABLES = {
    "raw": [_RAW],
    "stg": [_RAW, _STG],
    "pg": [_RAW, _STG, _PG],
    "ustats": [_RAW, _STG, _PG, _DAILY],
    "dim": [_RAW, _STG, _PG, _USERS],
    "runs": [_RAW, _STG, _PG, _RUNS],
    "mydaily": [_RAW, _STG, _PG, _DAILY, _RUNS, _MYDAILY],
    "parsed": [_RAW, _PARSE],
    "an": [_RAW, _PARSE],
    "tracked": [_RAW, _TRACKED],
}


def over(*tables: str, extra: str = "") -> str:
    """A ``WITH`` clause that defines the named tables."""
    parts: list[str] = []
    for table in tables:
        parts += [p for p in _TABLES[table] if p not in parts]
    if extra:
        parts.append(extra)
    return "WITH " + ",".join(parts) + "\n"
