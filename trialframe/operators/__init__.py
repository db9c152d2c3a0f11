"""Jobs on criteria: each takes and returns DataFrames."""
