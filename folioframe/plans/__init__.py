"""Query catalogues: name -> callable, name -> oracle SQL."""
