from lumenact import session


def test_own_settings_stay(spark):
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    other = spark.newSession()
    other.conf.set(key, "7")
    session.configure(other)
    assert other.conf.get(key) == "7"
    assert other.conf.get("spark.sql.session.timeZone") == "UTC"
    other.conf.unset(key)
    assert session.configure(other).conf.get(key) == session.SETTINGS[key]
