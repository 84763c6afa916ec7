"""packetloom: audio bitstreams as Spark DataFrames."""
