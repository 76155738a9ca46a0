"""R10 daily activity: the minimum end-to-end slice."""

from stackyard.operators.activity import daily_activity
from stackyard.plans.registry import query
from stackyard.tables import load


@query("r10_daily_activity", "R10", sql="""
WITH ud AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n
            FROM events GROUP BY user_id, CAST(ts AS DATE)),
     per_day AS (SELECT day, COUNT(*) AS active_users, CAST(SUM(n) AS BIGINT) AS n_events
                 FROM ud GROUP BY day),
     firsts AS (SELECT user_id, MIN(day) AS day FROM ud GROUP BY user_id),
     fresh AS (SELECT day, COUNT(*) AS new_users FROM firsts GROUP BY day)
SELECT p.day, p.active_users, COALESCE(f.new_users, 0) AS new_users, p.n_events
FROM per_day p LEFT JOIN fresh f ON p.day = f.day
""")
def r10_daily_activity(spark, sf_dir):
    return daily_activity(load(spark, sf_dir, "events"))
