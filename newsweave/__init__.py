"""newsweave: news-corpus ETL, topic clustering and editorial analytics on Spark."""
