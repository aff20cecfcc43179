"""SQL functions for queries in text: expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "hz_to_mel(hz DOUBLE)": "CASE WHEN hz < 1000 THEN hz * 3 / 200 ELSE 15 + ln(hz / 1000) * 27 / ln(6.4D) END",
    "mel_to_hz(mel DOUBLE)": "CASE WHEN mel < 15 THEN mel * 200 / 3 ELSE 1000 * exp((mel - 15) * ln(6.4D) / 27) END",
    "hz_to_erb(hz DOUBLE)": "24.7D * (4.37D * hz / 1000 + 1)",
    "erb_to_hz(erb DOUBLE)": "(erb / 24.7D - 1) * 1000 / 4.37D",
    "power_to_db(power DOUBLE, floor_db DOUBLE)": "10 * log10(greatest(power, pow(10D, floor_db / 10)))",
    "wrap_phase(angle DOUBLE)": "angle + pi() - floor((angle + pi()) / (2 * pi())) * 2 * pi() - pi()",
    "hann(i BIGINT, n BIGINT)": "0.5D - 0.5D * cos(2 * pi() * i / (n - 1))",
    "frame_count(n BIGINT, n_fft BIGINT, hop BIGINT, centre BOOLEAN)": "CASE WHEN n + if(centre, 2 * (n_fft div 2), 0) < n_fft THEN 1 ELSE (n + if(centre, 2 * (n_fft div 2), 0) - n_fft) div hop + 1 END",
}


def register(spark: SparkSession) -> list[str]:
    """Make FUNCTIONS temporary functions of the session; their names."""
    for head, body in FUNCTIONS.items():
        kind = "BIGINT" if head.startswith("frame_count") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
