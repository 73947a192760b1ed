"""Travel-itinerary and flight-delay analytics as Spark jobs."""
