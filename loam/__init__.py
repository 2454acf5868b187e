"""Document analytics on Spark: cleaning, matching, sequencing, checking and scoring as DataFrame functions."""
