"""Transforms: DataFrame in, DataFrame out; no actions inside, but where a loop needs one."""
